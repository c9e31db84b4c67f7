"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens, in DataFrame expressions alone.

A token of twenty characters or more of the base64 alphabets is held against what a random string in its encoding
(hexadecimal, base32, digits and small letters, base64) would be: chi-squared over the alphabet, runs of the upper and
lower half, serial correlation of neighbours. The three give one number, near 0 for text that is not random.

What is to be controlled is the share of ordinary tokens among those reported. So the law of that number is taken from
the corpus's own ordinary tokens, long words and words joined by marks, and a token's p-value is the share of ordinary
tokens that look at least as random, of its own or a smaller length, as the tests tell shorter tokens less well. Under
false-discovery control within strata of length, tokens that are too random for an ordinary one are discoveries.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, texts

# fixed values: the patterns that results depend on
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # whole runs of twenty or more; a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ORDINARY = r"^[A-Za-z]?[a-z]+(?:[-_/]+[A-Za-z]?[a-z]+)*$"
KINDS = ("assign", "access", "hex", "random")
ENCODINGS = {"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$": digits + "abcdef", "^(?=.*[2-7])[A-Z2-7]+$": ascii_uppercase + "234567", "^(?=.*[0-9])[a-z0-9]+$": digits + ascii_lowercase}
BASE64 = ascii_uppercase + ascii_lowercase + digits + "+/"
FDR = 0.05
STEPS = 400  # p-values are ranked in steps of a tenth of a decimal power, the last of them open


def counted(text: Column, what: str | Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what) if isinstance(what, str) else what, F.lit("")))) / (len(what) if isinstance(what, str) else 1)


def upper_tail(z: Column) -> Column:
    """Of the normal law, by a logistic curve; accurate to 0.0002, and in the far tail it keeps the order."""
    return 1 / (1 + F.exp(F.least(F.lit(600.0), 1.5976 * z + 0.070565992 * z * z * z)))


def battery(token: Column, alphabet: str) -> Column:
    """p-value of ``token`` as random text over ``alphabet``."""
    k, n = len(alphabet), F.length(token).cast("double")
    counts = F.transform(F.array(*map(F.lit, alphabet)), lambda a: counted(token, a))
    squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
    chi = squares * k / n - n
    # Wilson and Hilferty: the cube root of chi-squared over its freedom is nearly normal
    spread = 2 / (9 * (k - 1))
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / spread**0.5
    halves = F.translate(token, alphabet, "0" * (k // 2) + "1" * (k - k // 2))
    changes = counted(halves, "01") + counted(halves, "10")
    z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    values = F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(alphabet)) - (k + 1) / 2)
    pairs = F.zip_with(values, F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(1))), lambda a, b: F.coalesce(a * b, F.lit(0.0)))
    z_serial = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / ((k * k - 1) / 12) / F.sqrt(n - 1)
    total = F.pow(F.greatest(z_chi, F.lit(0.0)), 2) + z_runs * z_runs + z_serial * z_serial
    return upper_tail((F.pow(total / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / (2 / 27) ** 0.5)


def p_value(token: Column) -> Column:
    found = None
    for pattern, alphabet in ENCODINGS.items():
        found = (F.when if found is None else found.when)(token.rlike(pattern), battery(token, alphabet))
    plain = F.translate(token, "_-", "/+")
    return found.otherwise(battery(plain, BASE64))


def matches(text: Column, pattern: str, kind: int, ok, p=None, group: int = 0) -> Column:
    """Array of ``kind, place, gap, n, ok, p``: each match with the characters between it and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.zip_with(found, inner, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    with_gap = F.zip_with(both, F.split(text, pattern, -1), lambda m, gap: F.struct(m["m"].alias("m"), m["g"].alias("g"), F.length(gap).alias("gap")))
    real = F.filter(with_gap, lambda x: x["m"].isNotNull())
    return F.transform(real, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), x["gap"].alias("gap"), F.length(x["m"]).alias("n"), ok(x["g"]).alias("ok"), (p(x["m"]) if p else F.lit(None).cast("double")).alias("p")))


def of_kind(k: int):
    return lambda s: s["kind"] == k


def discoveries(tokens: DataFrame, fdr: float) -> DataFrame:
    """``stratum, cut``: tokens of a stratum up to this step of the p-value are discoveries; strata without any are left out.

    Input ``stratum, step, ordinary``: step 0 is most random. All that is gathered is a count for each stratum and step.
    """
    counts = tokens.groupBy("stratum", "step").agg(F.count(F.when(F.col("ordinary"), 1)).alias("null"), F.count(F.when(~F.col("ordinary"), 1)).alias("tested"))
    grid = counts.select("stratum").distinct().select("stratum", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("step"))
    rows = grid.join(counts, ["stratum", "step"], "left").fillna(0, ["null", "tested"])
    by_step = Window.partitionBy("stratum").orderBy("step")
    whole = Window.partitionBy("stratum")
    rows = rows.select("stratum", "step", "tested", F.sum("null").over(by_step).alias("null"), F.sum("null").over(whole).alias("nulls"), F.sum("tested").over(by_step).alias("rank"), F.sum("tested").over(whole).alias("m"))
    shorter = Window.partitionBy("step").orderBy("stratum")
    rows = rows.select("stratum", "step", "tested", "rank", "m", F.sum("null").over(shorter).alias("null"), F.sum("nulls").over(shorter).alias("nulls"))
    # Benjamini and Hochberg: the largest p-value that is at most its rank's share of the rate
    p = (F.col("null") + 1) / (F.col("nulls") + 1)
    return rows.where((F.col("tested") > 0) & (p <= fdr * F.col("rank") / F.col("m"))).groupBy("stratum").agg(F.max("step").alias("cut"))


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` for every row of ``docs``.

    Spans are in code points, ends excluded. Null and empty texts have no spans. One pass over the texts leaves a small
    row for each match; positions are running sums within a row's matches. Thresholds come from counts by length stratum
    and step, a few thousand numbers for a corpus of any size, over all tokens; a corpus without ordinary tokens has no
    discoveries. A random token that is a base span as a whole is not reported again. Repeated rows stay apart.
    """
    yes = lambda g: F.lit(True)
    text = F.col("text")
    found = F.concat(matches(text, ASSIGN, 0, lambda g: F.length(g) >= 6, group=2), matches(text, ACCESS, 1, yes), matches(text, HEX, 2, yes), matches(text, TOKEN, 3, lambda g: g.rlike(ORDINARY), p_value))
    rows = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found"))
    rows = checkpointed(rows.select("row", "doc_id", F.explode_outer("found").alias("f")).select("row", "doc_id", "f.*"))

    step = F.least(F.lit(STEPS), F.greatest(F.lit(0), F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-300))) * 10))).cast("int")
    stratum = F.floor(F.log2(F.col("n").cast("double")) * 2).cast("int")
    cut = discoveries(rows.where("p is not null").select(stratum.alias("stratum"), step.alias("step"), F.col("ok").alias("ordinary")), fdr)

    upto = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).withColumn("stratum", F.when(F.col("p").isNotNull(), stratum)).withColumn("step", step)
    judged = placed.join(cut, "stratum", "left").withColumn("keep", F.when(F.col("kind") == 3, F.coalesce(~F.col("ok") & (F.col("step") <= F.col("cut")), F.lit(False))).otherwise(F.col("ok")))
    span = F.struct((F.col("end") - F.col("n")).alias("start"), "kind", "end")
    grouped = judged.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("keep"), span))).alias("all"))
    places = F.transform(F.filter("all", lambda s: s["kind"] < 3), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    new = lambda s: (s["kind"] < 3) | ~F.array_contains(places, F.struct(s["start"].alias("start"), s["end"].alias("end")))
    grouped = grouped.withColumn("spans", F.filter("all", new))
    grouped = grouped.select("doc_id", "spans", *[F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)])
    named = F.array(*map(F.lit, KINDS))

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"], s["end"])), ",")

    base = line(F.filter("spans", lambda s: s["kind"] < 3))
    return grouped.select("doc_id", *[f"n_{name}" for name in KINDS], F.sha2(base, 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
