"""String and number rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .lookups import any_of, lookup, nullif_empty

# characters stripped from both ends wherever a value is trimmed
WHITESPACE = " \t\n\r\v\f\u0085\u00a0"
INT64_MAX = 9223372036854775807


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITESPACE))


def same_text(left: Column, right: Column) -> Column:
    """Case-insensitive equality. Uses lower-casing, which equals simple folding for ASCII names."""
    return F.lower(left) == F.lower(right)


# --- severities -------------------------------------------------------------------------------
def severity_normalize(raw: Column) -> Column:
    return F.coalesce(lookup(V.SEVERITY_ALIASES, F.upper(strip(raw))), F.lit("Unknown"))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(lookup(V.SEVERITY_RANK, severity), F.lit(V.UNKNOWN_RANK))


def sarif_level(severity: Column) -> Column:
    return F.coalesce(lookup(V.SARIF_LEVEL, severity), F.lit("none"))


def security_score(severity: Column) -> Column:
    return F.coalesce(lookup(V.SECURITY_SCORE, severity), F.lit("0.0"))


def rule_name(finding_id: Column) -> Column:
    """``AR-PY-001`` becomes ``ArPy001``."""
    parts = F.filter(F.split(F.lower(finding_id), "-"), lambda p: p != "")
    titled = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.array_join(titled, "")


def finding_tags(category: Column, tool: str = "fleetrisk") -> Column:
    return F.array_compact(
        F.array(
            F.lit(tool),
            nullif_empty(category),
            F.when(category == "drift", F.lit("supply-chain")),
        )
    )


def status_for(findings: Column) -> Column:
    return F.when(findings > 0, "Failed").otherwise("Passed")


def worst_exit(worst: Column) -> Column:
    """Exit class of the most severe finding."""
    return (
        F.when(worst == "Critical", V.EXIT_CODES["critical"])
        .when(worst.isin("High", "Medium"), V.EXIT_CODES["findings"])
        .otherwise(V.EXIT_CODES["clean"])
    )


def verdict_exit(verdict: Column) -> Column:
    return (
        F.when(verdict == "Quarantined", V.EXIT_CODES["critical"])
        .when(verdict == "ReviewRequired", V.EXIT_CODES["findings"])
        .otherwise(V.EXIT_CODES["clean"])
    )


# --- licenses ---------------------------------------------------------------------------------
def license_key(raw: Column) -> Column:
    key = F.lower(strip(raw))
    key = F.when(F.startswith(key, F.lit("spdx:")), F.substr(key, F.lit(6))).otherwise(key)
    return F.when(F.startswith(key, F.lit("license: ")), F.substr(key, F.lit(10))).otherwise(key)


def license_resolve(raw: Column) -> Column:
    """Struct ``(spdx_id, confidence)``; blank input has no id."""
    text = strip(raw)
    by_id = {spdx.lower(): spdx for spdx in V.LICENSE_ALIASES.values()}
    key = license_key(raw)
    exact = lookup(by_id, F.lower(text))
    normalized = lookup(V.LICENSE_ALIASES, key)
    model = lookup(V.MODEL_LICENSES, key)
    reference = F.regexp_replace(F.regexp_replace(text, r"[ _/]", "-"), r"[^A-Za-z0-9.\-]", "")
    reference = F.coalesce(nullif_empty(F.btrim(reference, F.lit("-"))), F.lit("unknown"))
    blank = F.coalesce(text, F.lit("")) == ""
    return F.struct(
        F.when(~blank, F.coalesce(exact, normalized, model, F.concat(F.lit("LicenseRef-"), reference))).alias(
            "spdx_id"
        ),
        F.when(blank, "none")
        .when(exact.isNotNull(), "exact")
        .when(normalized.isNotNull(), "normalized")
        .when(model.isNotNull(), "model")
        .otherwise("none")
        .alias("confidence"),
    )


# --- declared against measured ------------------------------------------------------------------
def dtype_agrees(declared: Column, measured: Column) -> Column:
    name = F.lower(strip(declared))
    return same_text(F.coalesce(lookup(V.DTYPE_ALIASES, name), name), measured)


def arch_agrees(declared: Column, measured: Column) -> Column:
    d = F.coalesce(F.lower(strip(declared)), F.lit(""))
    m = F.coalesce(F.lower(strip(measured)), F.lit(""))
    return (d == "") | (m == "") | F.contains(d, m) | F.contains(m, d)


def parse_count(raw: Column) -> Column:
    """``8B``, ``1.5b``, ``70M``, ``1,234`` to a count; anything else is 0."""
    text = F.regexp_replace(F.lower(strip(raw)), "[,_]", "")
    suffix = F.right(text, F.lit(1))
    multiplier = F.when(suffix == "b", 1e9).when(suffix == "m", 1e6).when(suffix == "k", 1e3).otherwise(1.0)
    digits = strip(F.when(suffix.isin("b", "m", "k"), F.left(text, F.length(text) - 1)).otherwise(text))
    number = F.when(
        F.rlike(digits, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$")),
        digits.try_cast("double"),
    )
    count = number * multiplier
    return F.when((number > 0) & (count < float(2**63)), count.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def one_decimal(number: Column) -> Column:
    """A double of at least 1 with one decimal, rounded as its exact binary value lies.

    Formatting by the JVM rounds the shortest decimal text instead, which turns 657.15 (a little less in binary) up.
    Twenty times the number is taken as a product and its exact error, so the comparison with the middle is exact.
    """
    tenths = F.floor(number * 10)
    spread = number * F.lit(134217729.0)  # 2^27 + 1 parts the 53 bits in two halves
    high = spread - (spread - number)
    product = number * 20
    error = (high * 20 - product) + (number - high) * 20
    beyond = (product - (2 * tenths + 1)) + error
    rounded = tenths + F.when((beyond > 0) | ((beyond == 0) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def human_count(count: Column) -> Column:
    def scaled(unit: float, label: str) -> Column:
        return F.concat(one_decimal(count / F.lit(unit)), F.lit(label))

    return (
        F.when(count >= 1_000_000_000, scaled(1e9, "B"))
        .when(count >= 1_000_000, scaled(1e6, "M"))
        .when(count >= 1_000, scaled(1e3, "K"))
        .otherwise(count.cast("string"))
    )


def max_ratio(ratio: Column) -> Column:
    return F.when(ratio < 1, 1 / ratio).otherwise(ratio)


def element_count(shape: Column) -> Column:
    """Product of the dimensions; 0 when empty or when one is not positive; saturates at int64 max."""
    product = F.aggregate(
        shape,
        F.lit(1).cast("bigint"),
        lambda acc, d: F.coalesce(F.try_multiply(acc, d.cast("bigint")), F.lit(INT64_MAX)),
    )
    unusable = (F.size(shape) <= 0) | F.exists(shape, lambda d: d <= 0)
    return F.when(F.coalesce(unusable, F.lit(True)), F.lit(0).cast("bigint")).otherwise(product)


def positive_element_count(shape: Column) -> Column:
    """The weighting used for the dominant type: dimensions that are not positive are skipped."""
    positive = F.filter(F.coalesce(shape, F.array().cast("array<bigint>")), lambda d: d > 0)
    return F.aggregate(
        positive,
        F.lit(1).cast("bigint"),
        lambda acc, d: F.coalesce(F.try_multiply(acc, d.cast("bigint")), F.lit(INT64_MAX)),
    )


def dims_text(shape: Column, separator: str) -> Column:
    return F.array_join(F.transform(shape, lambda d: F.when(d < 0, "?").otherwise(d.cast("string"))), separator)


def io_format(dtype: Column, shape: Column, fmt: Column) -> Column:
    """``F32[1,?]``; falls back to the free-form format when neither type nor shape is known."""
    size = F.coalesce(F.size(shape), F.lit(0))
    bare = (F.coalesce(dtype, F.lit("")) == "") & (size <= 0)
    dims = F.coalesce(dims_text(shape, ","), F.lit(""))
    return F.when(bare, fmt).otherwise(F.concat(F.coalesce(dtype, F.lit("")), F.lit("["), dims, F.lit("]")))


def io_signature(inputs: Column, outputs: Column) -> Column:
    """``in(x:F32[1x2]) -> out(y:F32[1])``; NULL when both sides are empty."""

    def render(specs: Column) -> Column:
        def one(s: Column) -> Column:
            dims = F.when(F.size(s["shape"]) > 0, F.concat(F.lit("["), dims_text(s["shape"], "x"), F.lit("]")))
            return F.concat(
                F.coalesce(nullif_empty(s["name"]), F.lit("?")),
                F.lit(":"),
                F.coalesce(s["dtype"], F.lit("")),
                F.coalesce(dims, F.lit("")),
            )

        return F.coalesce(F.array_join(F.transform(specs, one), ", "), F.lit(""))

    left, right = render(inputs), render(outputs)
    return F.when(
        (left != "") | (right != ""), F.concat(F.lit("in("), left, F.lit(") -> out("), right, F.lit(")"))
    )


# --- identifiers ----------------------------------------------------------------------------------
def slug(text: Column, fallback: str = "x") -> Column:
    kept = F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._\-]", "-"), F.lit("-"))
    return F.coalesce(nullif_empty(kept), F.lit(fallback))


def short_id(sha: Column, fallback: Column) -> Column:
    return F.when(F.length(sha) >= 16, F.left(sha, F.lit(16))).otherwise(slug(fallback))


def short_hash(sha: Column) -> Column:
    return F.when(F.length(sha) > 16, F.concat(F.left(sha, F.lit(16)), F.lit("…"))).otherwise(sha)


def fingerprint(sha: Column, name: Column, finding_id: Column) -> Column:
    return F.concat(short_id(sha, name), F.lit(":"), finding_id)


def serial_uuid(seed: Column, prefix: str = "fleetrisk:") -> Column:
    """Deterministic version-4 shaped UUID of a seed."""
    digest = F.sha2(F.concat(F.lit(prefix), F.coalesce(seed, F.lit(""))), 256)
    variant = F.substring(
        F.lit("89ab"),
        1,
        4,
    )
    picked = F.substr(variant, (F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-4"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        picked,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def utf8_text(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes the replacement character, so that no content fails a job."""
    return F.make_valid_utf8(content.cast("string"))


def utf8_cut(text: Column, limit: int) -> Column:
    """Cut after ``limit`` bytes and mark the cut; a character split by the cut is left out."""
    raw = F.encode(text, "UTF-8")
    # stepping back over at most three continuation bytes (10xxxxxx) keeps the text valid UTF-8
    first_dropped = F.hex(F.substring(raw, limit + 1, 1))
    def is_continuation(position: int) -> Column:
        return F.hex(F.substring(raw, position, 1)).rlike("^[89AB]")
    keep = (
        F.when(~first_dropped.rlike("^[89AB]"), limit)
        .when(~is_continuation(limit), limit - 1)
        .when(~is_continuation(limit - 1), limit - 2)
        .otherwise(limit - 3)
    )
    cut = utf8_text(F.substr(raw, F.lit(1), keep))
    return F.when(F.octet_length(text) > limit, F.concat(cut, F.lit("..."))).otherwise(text)


# --- extensions -------------------------------------------------------------------------------------
def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def format_by_ext(path: Column) -> Column:
    return lookup(V.FORMAT_BY_EXT, extension(path))


def executes_on_load(path: Column, variant: str = "inspect") -> Column:
    lists = {
        "inspect": V.EXECUTES_ON_LOAD_INSPECT,
        "provenance": V.EXECUTES_ON_LOAD_PROVENANCE,
        "fetch": V.EXECUTES_ON_LOAD_FETCH,
    }
    return extension(path).isin(lists[variant])


# --- natural order ------------------------------------------------------------------------------------
def control_sort_key(function: Column, control_id: Column) -> Column:
    """Function order, then major and minor number as integers; 2.9 sorts before 2.10."""
    order = F.coalesce(lookup({"GOVERN": 0, "MAP": 1, "MEASURE": 2, "MANAGE": 3}, function), F.lit(0))
    numbers = F.regexp_extract(control_id, r" (.*)$", 1)
    major = F.coalesce(F.split_part(numbers, F.lit("."), F.lit(1)).try_cast("int"), F.lit(0))
    minor = F.coalesce(F.split_part(numbers, F.lit("."), F.lit(2)).try_cast("int"), F.lit(0))
    return F.struct(order.alias("function_order"), major.alias("major"), minor.alias("minor"))


def is_power_of_two(n: Column) -> Column:
    return n.bitwiseAND(n - 1) == 0


def quantization_name(file_type: Column) -> Column:
    number = file_type.try_cast("int")
    plain = F.rlike(file_type, F.lit(r"^[+-]?[0-9]+$"))
    return F.when(
        plain & number.isNotNull(),
        F.coalesce(lookup(V.QUANTIZATION_NAMES, number), F.concat(F.lit("file_type="), file_type)),
    ).otherwise(file_type)


def has_any(text: Column, needles: list[str]) -> Column:
    return any_of(F.contains(text, F.lit(n)) for n in needles)
