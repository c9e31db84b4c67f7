"""Signatures beside an artifact: finding them, scoping publishers, coverage and the roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions import values as V
from ..functions.lookups import nullif_empty


def _suffix(name: Column) -> Column:
    """First bundle suffix, in the listed order, that a name ends with and is longer than."""
    lower = F.lower(name)
    return F.coalesce(
        *[
            F.when(F.endswith(lower, F.lit(s)) & (F.length(name) > len(s)), F.lit(s))
            for s in V.SIGNATURE_BUNDLE_SUFFIXES
        ]
    )


def signatures(files: DataFrame) -> DataFrame:
    """Signature files with kind, target and the certificate beside a detached one."""
    name, path = S.base_name(F.col("path")), F.col("path")
    suffix = _suffix(name)
    kind = (
        F.when(F.lower(name).isin(V.SIGNATURE_MANIFEST_NAMES), "manifest")
        .when(suffix.isNotNull(), "bundle")
        .when(F.endswith(name, F.lit(".sig")), "detached")
    )
    # a suffix is matched ignoring case but only taken off when written exactly so
    without = F.when(F.endswith(path, suffix), F.left(path, F.length(path) - F.length(suffix))).otherwise(path)
    target = F.when(kind == "bundle", without).when(kind == "detached", F.left(path, F.length(path) - 4))
    found = files.select("artifact_id", "path", kind.alias("kind"), target.alias("target")).filter("kind IS NOT NULL")
    # certificates are few, so each candidate is an equi-join on the full path
    certs = files.filter(S.extension(path).isin(V.SIGNATURE_CERT_EXTS)).select("artifact_id", "path")
    order = F.create_map(*[x for i, e in enumerate(V.SIGNATURE_CERT_EXTS) for x in (F.lit(e), F.lit(i))])
    exact_ext = F.regexp_extract("path", r"(\.[^.]*)$", 1)
    by_target = (
        certs.select(
            "artifact_id",
            F.regexp_replace("path", r"\.[^.]*$", "").alias("target"),
            F.try_element_at(order, exact_ext).alias("_o"),
            F.col("path").alias("cert_path"),
        )
        .filter("_o IS NOT NULL")
        .groupBy("artifact_id", "target")
        .agg(F.min_by("cert_path", "_o").alias("cert_path"))
        .withColumn("kind", F.lit("detached"))
    )
    return found.join(by_target, ["artifact_id", "target", "kind"], "left").select(
        "artifact_id", "path", "kind", "target", "cert_path"
    )


def plain_files(files: DataFrame) -> DataFrame:
    """Files that are neither a signature nor the certificate of one."""
    found = signatures(files)
    taken = found.select("artifact_id", "path").unionByName(
        found.filter("cert_path IS NOT NULL").select("artifact_id", F.col("cert_path").alias("path"))
    )
    return files.join(taken.distinct(), ["artifact_id", "path"], "left_anti")


SAMPLE_ROWS = 20_000  # URIs, about, from which the borders of ranges are taken; they decide balance, never a result


def _borders(uris: DataFrame, n: int) -> list[str]:
    """Up to ``n - 1`` URIs that cut the sorted rows into ranges of about equal size; a frequent URI comes repeatedly."""
    step = max(1, uris.count() // SAMPLE_ROWS)
    sample = sorted(r.uri for r in uris.filter(F.pmod(F.xxhash64("uri", "artifact_id"), F.lit(step)) == 0).select("uri").collect())
    return [sample[len(sample) * i // n] for i in range(1, n)] if sample else []


def prefix_join(uris: DataFrame, prefixes: DataFrame, ranges: int | None = None) -> DataFrame:
    """``artifact_id, uri, entry``: each URI with the ``entry`` of every ``prefix`` that begins it.

    An ordered merge. URIs and prefixes are dealt by ranges of their text; a prefix goes to every range that can hold
    URIs with it, which is one but for the few that span a border. Sorted together, the prefixes of a URI are those still
    open when it comes: each range keeps them on a stack. So a URI is shuffled once, however many lengths prefixes have.
    Rows of one URI that make up several ranges are dealt over them by artifact.
    """
    spark = uris.sparkSession
    borders = _borders(uris, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = F.array(*map(F.lit, borders)).cast("array<string>")
    below = lambda text: F.size(F.filter(edges, lambda b: b < text))
    equal = lambda text: F.size(F.filter(edges, lambda b: b == text))
    first = below(F.col("prefix"))
    spanned = F.size(F.filter(edges, lambda b: F.startswith(b, F.col("prefix"))))
    entry_type = dict(prefixes.dtypes)["entry"]
    left = prefixes.select(
        F.explode(F.sequence(first, first + spanned)).alias("range"), F.col("prefix").alias("text"), F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("artifact_id"), "entry",
    )
    right = uris.select(
        (below(F.col("uri")) + F.pmod(F.hash("artifact_id"), equal(F.col("uri")) + 1)).alias("range"), F.col("uri").alias("text"), F.lit(1).alias("kind"), "artifact_id",
        F.lit(None).cast(entry_type).alias("entry"),
    )

    def run(batches):
        import pyarrow as pa

        current, stack, numbers, entries = None, [], [], None
        for batch in batches:
            table = pa.table(batch)
            # entries of open prefixes are kept as an Arrow column and taken by number
            entries = table["entry"].combine_chunks() if entries is None else pa.concat_arrays([entries, table["entry"].combine_chunks()])
            base = len(entries) - batch.num_rows
            at, which, taken = [], [], []
            for i, (number, text, kind) in enumerate(zip(*(table[c].to_pylist() for c in ("range", "text", "kind")))):
                if number != current:
                    current, stack = number, []
                while stack and not text.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((text, base + i))
                else:
                    at.extend([i] * len(stack))
                    taken.extend(place for _, place in stack)
            rows = table.take(pa.array(at, pa.int64()))
            yield from pa.table([rows["artifact_id"], rows["text"], entries.take(pa.array(taken, pa.int64()))], names=["artifact_id", "uri", "entry"]).to_batches()
            entries = entries.take(pa.array([place for _, place in stack], pa.int64()))
            stack = [(text, i) for i, (text, _) in enumerate(stack)]

    n = len(borders) + 1
    dealt = left.unionByName(right).repartition(n, "range").sortWithinPartitions("range", "text", "kind")
    return dealt.mapInArrow(run, f"artifact_id string, uri string, entry {entry_type}")


def publisher_scope(artifacts: DataFrame, publishers: DataFrame) -> DataFrame:
    """Publishers accepted for each artifact URI: no prefixes means any, else one prefix must match."""
    none = F.coalesce("uri_prefixes", F.array().cast("array<string>"))
    label = F.coalesce(nullif_empty(F.col("display_name")), F.col("name"))
    keyless = (F.coalesce("issuer", F.lit("")) != "") & (F.coalesce("subject", F.lit("")) != "")
    shown = (
        F.when(keyless, F.concat(label, F.lit(" ("), F.col("subject"), F.lit(" via "), F.col("issuer"), F.lit(")")))
        .when(F.coalesce("public_key", F.lit("")) != "", F.concat(label, F.lit(" (public key)")))
        .otherwise(label)
    )
    entry = F.struct(F.col("name").alias("publisher"), keyless.alias("keyless"), shown.alias("label"), "subject")
    scoped = publishers.select(F.explode(F.when(F.size(none) > 0, none).otherwise(F.array(F.lit("")))).alias("prefix"), entry.alias("entry"))
    uris = artifacts.select("artifact_id", "uri").filter("uri IS NOT NULL")
    found = prefix_join(uris, scoped.filter("prefix IS NOT NULL").distinct())
    return found.select("artifact_id", "uri", "entry.*").distinct()


def subject_matches(subject: Column, san: Column) -> Column:
    """Exact, or a prefix when the subject ends with a star."""
    starred = F.endswith(subject, F.lit("*"))
    return F.when(starred, F.startswith(san, F.left(subject, F.length(subject) - 1))).otherwise(san == subject)


def manifest_coverage(subjects: DataFrame, files: DataFrame) -> DataFrame:
    """Statement subjects against staged digests. Input ``(artifact_id, sig_path, name, sha256)``.

    A subject without sha256 is skipped; any mismatch makes the whole signature fail.
    """
    stated = subjects.filter(F.col("sha256").isNotNull())
    staged = files.select("artifact_id", F.col("path").alias("name"), F.col("sha256").alias("staged"))
    state = (
        F.when(F.col("staged").isNull(), "not staged")
        .when(S.same_text(F.col("staged"), F.col("sha256")), "covered")
        .otherwise("digest differs")
    )
    return stated.join(staged, ["artifact_id", "name"], "left").withColumn("state", state).drop("staged")


def manifest_outcome(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("artifact_id", "sig_path").agg(
        F.count_if(F.col("state") == "covered").alias("covered"),
        F.count_if(F.col("state") != "covered").alias("mismatched"),
        F.bool_and(F.col("state") == "covered").alias("matches"),
    )


def unsigned_executables(files: DataFrame, covered: DataFrame) -> DataFrame:
    """Plain files in formats that run code on load and that no valid signature covers.

    No signature or certificate has one of these extensions, so signatures need not be found first.
    """
    runs = files.filter(S.executes_on_load(F.col("path"), "provenance")).select("artifact_id", "path")
    return runs.join(covered.select("artifact_id", "path").distinct(), ["artifact_id", "path"], "left_anti")


def failure_class(message: Column) -> Column:
    """Struct ``(id, severity)`` of a verification failure; the first group of words that matches wins."""
    text = F.lower(message)
    identity = (
        F.contains(text, F.lit("certificate identity"))
        | F.contains(text, F.lit("no matching certificate"))
        | (F.contains(text, F.lit("subject")) & F.contains(text, F.lit("mismatch")))
    )
    rule = F.when(F.coalesce(identity, F.lit(False)), "AR-PROV-003").otherwise("AR-PROV-002")
    return F.struct(
        rule.alias("id"), F.when(rule == "AR-PROV-002", "Critical").otherwise("High").alias("severity")
    )


def rollup(artifacts: DataFrame, files: DataFrame, outcomes: DataFrame, configured: bool = True) -> DataFrame:
    """One row per artifact: is it verified, by whom, and which findings follow.

    ``outcomes(artifact_id, sig_path, valid, failed, signer, covered array<string>)`` comes from the
    verifier. Without publishers or a trust root nothing is checked and presence is all that is reported.
    """
    counted = signatures(files).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("signatures"))
    judged = outcomes.groupBy("artifact_id").agg(
        F.bool_or("valid").alias("any_valid"),
        F.bool_or("failed").alias("had_failure"),
        F.min(F.when(F.col("valid"), nullif_empty(F.col("signer")))).alias("signer"),
    )
    covered = (
        outcomes.filter("valid").select("artifact_id", F.explode("covered").alias("path")).distinct()
    )
    covered_count = covered.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("covered_files"))
    unsigned = unsigned_executables(files, covered).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("unsigned"))
    rows = (
        artifacts.select("artifact_id")
        .join(counted, "artifact_id", "left")
        .join(judged, "artifact_id", "left")
        .join(covered_count, "artifact_id", "left")
        .join(unsigned, "artifact_id", "left")
        .fillna(0, ["signatures", "covered_files", "unsigned"])
        .fillna(False, ["any_valid", "had_failure"])
    )
    signed = F.col("signatures") > 0
    checked = signed & F.lit(configured)
    verified = checked & F.col("any_valid") & ~F.col("had_failure") & (F.col("unsigned") == 0)
    finding = (
        F.when(~signed, "AR-PROV-001")
        .when(~checked, "AR-PROV-006")
        .when(F.col("any_valid") & (F.col("unsigned") > 0), "AR-PROV-005")
        .when(verified, "AR-PROV-000")
    )
    severity = (
        F.when(finding.isin("AR-PROV-001", "AR-PROV-006"), "Medium")
        .when(finding == "AR-PROV-005", "High")
        .when(finding == "AR-PROV-000", "Low")
    )
    return rows.select(
        "artifact_id",
        "signatures",
        F.when(checked, F.col("covered_files")).otherwise(0).alias("covered_files"),
        F.when(checked, F.col("unsigned")).otherwise(0).alias("unsigned_executables"),
        verified.alias("verified"),
        F.when(checked, F.col("signer")).alias("signer"),
        finding.alias("finding_id"),
        severity.alias("severity"),
    )
