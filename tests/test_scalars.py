"""Scalar rules at their boundaries."""

import hashlib

from pyspark.sql import functions as F

from fleetrisk.functions import paths as P
from fleetrisk.functions import text as S


def values(spark, expression, inputs, schema="x string"):
    df = spark.createDataFrame([(i, *((v,) if not isinstance(v, tuple) else v)) for i, v in enumerate(inputs)], f"i int, {schema}")
    return [r[1] for r in df.select("i", expression).orderBy("i").collect()]


def test_severity_normalize(spark):
    got = values(spark, S.severity_normalize(F.col("x")), ["moderate", " negligible\t", "INFO", "informational", "", "odd", None, "critical", "High"])
    assert got == ["Medium", "Low", "Low", "Low", "Unknown", "Unknown", "Unknown", "Critical", "High"]


def test_parse_count(spark):
    inputs = ["8B", "1.5b", "125m", "1,000,000", "1_500_000", "", "large", "-3B", "0", "inf", "nan", "1e400", "9e18b", " 2 k ", "1.5d", "0x10"]
    got = values(spark, S.parse_count(F.col("x")), inputs)
    assert got == [8_000_000_000, 1_500_000_000, 125_000_000, 1_000_000, 1_500_000, 0, 0, 0, 0, 0, 0, 0, 0, 2000, 0, 0]


def test_license_resolve(spark):
    inputs = ["Apache-2.0", "apache-2.0", "apache 2.0", "bsd 3-clause", "llama3", "Some Custom License v1!", "", None, "SPDX:MIT", "License: gplv3", "///"]
    got = values(spark, S.license_resolve(F.col("x")), inputs)
    assert [tuple(r) for r in got] == [
        ("Apache-2.0", "exact"), ("Apache-2.0", "exact"), ("Apache-2.0", "normalized"), ("BSD-3-Clause", "normalized"),
        ("LicenseRef-Llama-3", "model"), ("LicenseRef-Some-Custom-License-v1", "none"), (None, "none"), (None, "none"),
        ("MIT", "normalized"), ("GPL-3.0-only", "normalized"), ("LicenseRef-unknown", "none"),
    ]


def test_element_count(spark):
    inputs = [[], [2, 3], [2, 0], [-1, 4], [2**40, 2**40], None, [3037000500, 3037000500]]
    got = values(spark, S.element_count(F.col("x")), inputs, "x array<bigint>")
    assert got == [0, 6, 0, 0, 2**63 - 1, 0, 2**63 - 1]
    got = values(spark, S.positive_element_count(F.col("x")), inputs, "x array<bigint>")
    assert got[:5] == [1, 6, 2, 4, 2**63 - 1]


def test_io_and_names(spark):
    assert values(spark, S.rule_name(F.col("x")), ["AR-PY-001", "a--b", ""]) == ["ArPy001", "AB", ""]
    assert values(spark, S.slug(F.col("x")), ["a b/c", "--", "ok_1.x", "é"]) == ["a-b-c", "x", "ok_1.x", "x"]
    cut = values(spark, S.utf8_cut(F.col("x"), 4), ["abcd", "abcde", "abcé", "aééé", "ab€€"])
    assert cut == ["abcd", "abcd...", "abc...", "aé...", "ab..."]
    quant = values(spark, S.quantization_name(F.col("x")), ["15", "99", "Q", "4"])
    assert quant == ["Q4_K_M", "file_type=99", "Q", "file_type=4"]


def test_serial_uuid_matches_hashlib(spark):
    def expected(seed):
        h = hashlib.sha256(b"fleetrisk:" + seed.encode()).hexdigest()
        variant = "89ab"[int(h[16:18], 16) % 4]
        return f"{h[:8]}-{h[8:12]}-4{h[13:16]}-{variant}{h[17:20]}-{h[20:32]}"

    seeds = ["", "a", "model", "x" * 99]
    assert values(spark, S.serial_uuid(F.col("x")), seeds) == [expected(s) for s in seeds]


def test_paths(spark):
    inputs = ["a/b", "/a", "..\\x", "C:\\w", "C:f", "a/..b", "a/../b", "\\\\server\\s", ""]
    assert values(spark, P.path_traversal(F.col("x")), inputs) == [False, True, True, True, True, False, True, True, False]
    assert values(spark, P.archive_traversal(F.col("x")), inputs) == [False, True, True, False, False, False, True, True, False]
    links = [("a/l", "../../etc"), ("a/l", "../b"), ("l", "/root/x/y"), ("l", "/root/x2/y"), ("a/b/l", "../../../root/x/q")]
    escapes = P.link_escape(F.lit("/root/x"), F.col("p"), F.col("t"))
    assert values(spark, escapes, links, "p string, t string") == [True, False, False, True, True]
    names = ["", ".", "/a", "..", "../a", "a/../b", "a\\b", "ok", "a..b"]
    want = ["empty name", "empty name", "absolute path", "traversal", "traversal", "traversal", "backslash", None, None]
    assert values(spark, P.unsafe_bundle_name(F.col("x")), names) == want
    assert values(spark, P.safe_join("/base", F.col("x")), ["a/b", "../../x", "..\\y", ""]) == ["/base/a/b", "/base/x", "/base/y", "/base"]


def test_uris(spark):
    uris = ["hf://o/m@rev", "https://huggingface.co/o/m/tree/main", "hf://o/m/blob/dev/", "huggingface://m", "hf://", "a/b/c", "HF://o/m@a@b"]
    got = [tuple(r) for r in values(spark, P.hub_reference(F.col("x")), uris)]
    assert got == [
        ("o/m", "rev", None), ("o/m", "main", None), ("o/m", "dev", None), ("m", None, None),
        (None, None, "no repository"), (None, None, "too many segments"), ("o/m@a", "b", None),
    ]
    pairs = [("https://HuggingFace.co/o/r/tree/x", "ABC"), ("https://hf.co/o/r", ""), ("https://hf.co/o", "x"), ("https://example.org/o/r", "x"), (None, "x")]
    assert values(spark, P.purl(F.col("u"), F.col("c")), pairs, "u string, c string") == [
        "pkg:huggingface/o/r@abc", "pkg:huggingface/o/r", None, None, None,
    ]
    assert values(spark, P.hub_url(F.col("x")), ["a/b", "a", "a/b/c", "a b/c", "a:/b"]) == ["https://huggingface.co/a/b", None, None, None, None]


def test_control_order(spark):
    keys = values(spark, S.control_sort_key(F.lit("MEASURE"), F.col("x")), ["MEASURE 2.9", "MEASURE 2.10", "MEASURE 3"])
    assert [tuple(k) for k in keys] == [(2, 2, 9), (2, 2, 10), (2, 3, 0)]


def test_one_decimal_rounds_the_binary_value(spark):
    rng = __import__("random").Random(3)
    counts = [657_150, 657_250, 1000, 1050, 1150, 999_949, 999_950, 10**18 + 1, 2**63 - 1] + [rng.randrange(1000, 10 ** rng.randrange(4, 19)) for _ in range(400)] + [50 + 100 * rng.randrange(10, 99_999) for _ in range(400)]
    got = spark.createDataFrame([(c,) for c in counts], "n long").select(S.human_count(F.col("n"))).collect()
    label = lambda n: f"{n / 1e9:.1f}B" if n >= 10**9 else f"{n / 1e6:.1f}M" if n >= 10**6 else f"{n / 1e3:.1f}K"
    assert [r[0] for r in got] == [label(n) for n in counts]
