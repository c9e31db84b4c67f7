"""One pass over a content for all byte patterns of the detectors.

The patterns share one automaton (a trie with failure links), so a content is read once however many there are. What
comes back is the short list of the patterns that occur, which detectors test instead of the content.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V

SLICE = 16 << 20  # bytes searched at once; a slice takes the end of the one before along


def operand_forms(name: str) -> list[bytes]:
    """The two ways in which a stream pushes a string: short, and with a four-byte length."""
    raw = name.encode()
    return [bytes([V.PICKLE_SHORT_STRING, len(raw)]) + raw, bytes([V.PICKLE_LONG_STRING]) + len(raw).to_bytes(4, "little") + raw]


def import_forms(name: str) -> tuple[bytes, list[bytes], list[bytes]]:
    """A callable as one line pair, and the pushed forms of its module and of its attribute."""
    module, attribute = name.split(".", 1)
    return f"{module}\n{attribute}\n".encode(), operand_forms(module), operand_forms(attribute)


def layer_forms(name: str) -> list[bytes]:
    return [f'"class_name"{gap}"{name}"'.encode() for gap in (": ", ":", " : ")]


CLASS_NAME = b'"class_name"'
CLIMBING = {"location": [b"external_data", b"location"], "up": [b"../"]}
KERAS_LAYERS = ["Lambda", "TFSMLayer"]


def all_patterns() -> list[bytes]:
    found: list[bytes] = []
    for name in V.DANGEROUS_IMPORTS:
        inline, module, attribute = import_forms(name)
        found += [inline, *module, *attribute]
    for name in KERAS_LAYERS:
        found += layer_forms(name)
    found += [op.encode() for op in (*V.SAVED_MODEL_OPS, *V.ONNX_OPS)]
    found += [p for group in CLIMBING.values() for p in group]
    found += [n.encode() for rule in V.PYTHON_RULES for n in rule[5]] + [m.encode() for m in V.NATIVE_EXTENSION_MARKERS]
    return sorted(set(found))


PATTERNS = all_patterns()
NUMBER = {p: i for i, p in enumerate(PATTERNS)}
LONGEST = max(map(len, PATTERNS))


def searcher(patterns: list[bytes], slice_bytes: int = SLICE):
    """A function from bytes to the sorted numbers of the patterns in them. A closure: executors need not have this package."""
    overlap = max(map(len, patterns)) - 1

    def build():
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, pattern in enumerate(patterns):
            automaton.add_word(pattern.decode("latin-1"), i)
        automaton.make_automaton()

        def search(content) -> list[int]:
            view, found = memoryview(content), set()
            for low in range(0, max(len(view), 1), slice_bytes):
                text = str(view[max(0, low - overlap) : low + slice_bytes], "latin-1")
                found.update(i for _, i in automaton.iter(text))
            return sorted(found)

        return search

    return build


def hits(content: Column, patterns: list[bytes] | None = None) -> Column:
    """Numbers of the patterns that occur in ``content``; none for NULL."""
    build = searcher(PATTERNS if patterns is None else patterns)

    def search_all(arrays):
        import pyarrow as pa

        search = build()
        for contents in arrays:
            found = [search(c.as_buffer()) if c.is_valid else [] for c in contents]
            yield pa.array(found, pa.list_(pa.int32()))

    import pyarrow as pa

    search_all.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(search_all, "array<int>")(content)


def occurs(found: Column, *patterns: bytes) -> Column:
    """Whether one of ``patterns`` is among the numbers ``found``."""
    wanted = [NUMBER[p] for p in patterns]
    if len(wanted) == 1:
        return F.array_contains(found, wanted[0])
    return F.arrays_overlap(found, F.array(*map(F.lit, wanted)))


def _numbers(patterns: Iterable[bytes]) -> Column:
    return F.array(*[F.lit(NUMBER[p]) for p in patterns])


def imports_of(found: Column, combines: Column) -> Column:
    """The dangerous callables that ``found`` names: inline, or module and attribute pushed in a stream that combines them."""
    table = []
    for name in V.DANGEROUS_IMPORTS:
        inline, module, attribute = import_forms(name)
        table.append(F.struct(F.lit(name).alias("name"), F.lit(NUMBER[inline]).alias("inline"), _numbers(module).alias("module"), _numbers(attribute).alias("attribute")))
    named = F.filter(
        F.array(*table),
        lambda row: F.array_contains(found, row["inline"]) | (combines & F.arrays_overlap(found, row["module"]) & F.arrays_overlap(found, row["attribute"])),
    )
    none = F.array().cast("array<string>")
    return F.when(F.size(found) > 0, F.transform(named, lambda row: row["name"])).otherwise(none)
