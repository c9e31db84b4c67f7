"""Documents against measured artifacts, bundle manifests, and attestations that bind the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import nullif_empty, rows_where
from ..functions.paths import unsafe_bundle_name
from ..functions.text import same_text, short_hash

OUTCOME_ORDER = {"fail": 0, "extra": 1, "uncheckable": 2, "pass": 3}
CHECK_KEYS = ["doc_id", "artifact_id"]
MEASURED_KEYS = {
    "architecture": "architecture",
    "quantization": "quantization",
    "dtype": "dtype",
    "measuredParameters": "measured_parameters",
}
MANIFEST_NAME = "manifest.json"
MANIFEST_VERSION = 1


def check(outcome, subject, claim=None, measured=None, detail=None) -> Column:
    def text(value) -> Column:
        column = value if isinstance(value, Column) else F.lit(value)
        return column.cast("string")

    return F.struct(
        text(outcome).alias("outcome"),
        text(subject).alias("subject"),
        text(claim).alias("claim"),
        text(measured).alias("measured"),
        text(detail).alias("detail"),
    )


def _compared(subject: Column | str, claim: Column, measured: Column, same: Column) -> Column:
    return check(F.when(F.coalesce(same, F.lit(False)), "pass").otherwise("fail"), subject, claim, measured)


def verify_files(docs: DataFrame, doc_files: DataFrame, files: DataFrame) -> DataFrame:
    """Documented against present files: a full outer join on (document, path).

    ``docs(doc_id, artifact_id)`` says which artifact a document describes.
    """
    claimed = doc_files.select(
        "doc_id",
        "path",
        *[nullif_empty(F.col(c)).alias(f"c_{c}") for c in ("sha256", "sha384")],
        F.col("size").alias("c_size"),
        F.lit(True).alias("_claimed"),
    )
    present = docs.select(*CHECK_KEYS).join(
        files.select(
            "artifact_id",
            "path",
            *[nullif_empty(F.col(c)).alias(f"m_{c}") for c in ("sha256", "sha384")],
            F.col("size").alias("m_size"),
            F.lit(True).alias("_present"),
        ),
        "artifact_id",
    )
    both = claimed.join(present.drop("artifact_id"), ["doc_id", "path"], "full_outer").join(
        docs.select(*CHECK_KEYS), "doc_id"
    )
    c = F.col
    name = F.concat(F.lit("file "), c("path"))
    in_doc, in_files = c("_claimed").isNotNull(), c("_present").isNotNull()
    has384 = c("c_sha384").isNotNull() & c("m_sha384").isNotNull()
    has256 = c("c_sha256").isNotNull() & c("m_sha256").isNotNull()

    def hashed(bits: str) -> Column:
        claim, measured = c(f"c_sha{bits}"), c(f"m_sha{bits}")
        same = same_text(claim, measured)
        return check(
            F.when(same, "pass").otherwise("fail"),
            F.concat(name, F.lit(f" (SHA-{bits})")),
            short_hash(claim),
            short_hash(measured),
            F.when(~same, "the bytes differ from the documented ones"),
        )

    cases = rows_where(
        (in_doc & ~in_files, check("fail", name, "present", None, "documented and not part of the artifact")),
        (in_doc & in_files & has384, hashed("384")),
        (in_doc & in_files & ~has384 & has256, hashed("256")),
        (in_doc & in_files & ~has384 & ~has256, check("uncheckable", name, None, None, "no digest in common")),
        (
            in_doc & in_files & (c("c_size") > 0) & (c("m_size") > 0) & (c("c_size") != c("m_size")),
            check("fail", F.concat(name, F.lit(" (size)")), c("c_size"), c("m_size")),
        ),
        (~in_doc & in_files, check("extra", name, None, short_hash(c("m_sha256")), "not listed in the document")),
    )
    return both.select(*CHECK_KEYS, F.explode(cases).alias("k")).select(*CHECK_KEYS, "k.*")


def verify_identity(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Model name ignoring case, and version exactly when both sides state one."""
    rows = docs.join(artifacts.select("artifact_id", "name", F.col("version").alias("m_version")), "artifact_id", "left")
    c = F.col
    has_name = F.coalesce(c("model_name"), F.lit("")) != ""
    has_versions = (F.coalesce(c("version"), F.lit("")) != "") & (F.coalesce(c("m_version"), F.lit("")) != "")
    cases = rows_where(
        (has_name, _compared("model name", c("model_name"), c("name"), same_text(c("model_name"), c("name")))),
        (has_versions, _compared("model version", c("version"), c("m_version"), c("version") == c("m_version"))),
    )
    return rows.select(*CHECK_KEYS, F.explode(cases).alias("k")).select(*CHECK_KEYS, "k.*")


def verify_properties(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The four measured properties against the document's claims; other claims are ignored."""
    measured = F.create_map(
        *[
            x
            for key, column in MEASURED_KEYS.items()
            for x in (
                F.lit(key),
                F.when(F.col(column) > 0, F.col(column).cast("string"))
                if column == "measured_parameters"
                else nullif_empty(F.col(column)),
            )
        ]
    )
    rows = docs.join(artifacts.select("artifact_id", measured.alias("_measured")), "artifact_id", "left")
    claims = rows.select(*CHECK_KEYS, "_measured", F.explode("properties").alias("key", "claim")).filter(
        F.col("key").isin(list(MEASURED_KEYS)) & (F.coalesce("claim", F.lit("")) != "")
    )
    got = F.try_element_at("_measured", F.col("key"))
    result = F.when(
        got.isNull(), check("uncheckable", F.col("key"), F.col("claim"), None, "the artifact does not record this")
    ).otherwise(_compared(F.col("key"), F.col("claim"), got, same_text(F.col("claim"), got)))
    return claims.select(*CHECK_KEYS, result.alias("k")).select(*CHECK_KEYS, "k.*")


def all_checks(docs: DataFrame, doc_files: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    return (
        verify_identity(docs, artifacts)
        .unionByName(verify_files(docs, doc_files, files))
        .unionByName(verify_properties(docs, artifacts))
    )


def sorted_checks(checks: DataFrame) -> DataFrame:
    """Worst outcome first, then subject."""
    order = F.coalesce(*[F.when(F.col("outcome") == o, n) for o, n in OUTCOME_ORDER.items()])
    return checks.withColumn("outcome_rank", order).orderBy("doc_id", "artifact_id", "outcome_rank", "subject")


def verify_summary(checks: DataFrame) -> DataFrame:
    """Counts by outcome. What cannot be checked does not block; something must have passed."""
    counts = checks.groupBy(*CHECK_KEYS).agg(
        *[
            F.count_if(F.col("outcome") == outcome).cast("int").alias(name)
            for name, outcome in [
                ("passed", "pass"),
                ("failed", "fail"),
                ("uncheckable", "uncheckable"),
                ("not_in_document", "extra"),
            ]
        ]
    )
    verified = (F.col("failed") == 0) & (F.col("not_in_document") == 0) & (F.col("passed") > 0)
    return counts.withColumn("verified", verified)


# --- bundle manifests -----------------------------------------------------------------------------------
def manifest_entries(files: DataFrame) -> DataFrame:
    """Entry rows of each manifest. Positions follow the global (manifest, path) order of the written table."""
    return files.select("manifest_id", "path", "size", "sha256", "sha512").orderBy("manifest_id", "path")


def manifest_build(manifests: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """Totals of each manifest and the first reason why it cannot be built, or NULL."""
    totals = files.groupBy("manifest_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("size").cast("bigint").alias("total_size")
    )
    undated = sources.groupBy("manifest_id").agg(
        F.count_if(F.coalesce("retrieved_at", F.lit("")) == "").alias("undated_sources"),
        F.count(F.lit(1)).alias("sources"),
    )
    rows = manifests.join(totals, "manifest_id", "left").join(undated, "manifest_id", "left")
    problem = (
        F.when(F.coalesce("entries", F.lit(0)) == 0, "no files")
        .when(F.coalesce("created_at", F.lit("")) == "", "no creation time")
        .when(F.coalesce("name", F.lit("")) == "", "no name")
        .when(F.coalesce("undated_sources", F.lit(0)) > 0, "source without a retrieval date")
    )
    return rows.select(
        "manifest_id",
        F.lit(MANIFEST_VERSION).alias("format_version"),
        F.coalesce(nullif_empty(F.col("kind")), F.lit("mixed")).alias("kind"),
        "name",
        "created_at",
        F.coalesce("entries", F.lit(0)).alias("entries"),
        F.coalesce("total_size", F.lit(0)).alias("total_size"),
        F.coalesce("sources", F.lit(0)).alias("sources"),
        problem.alias("problem"),
    )


def manifest_verify(manifests: DataFrame, entries: DataFrame, members: DataFrame) -> DataFrame:
    """All failures of bundles against their manifests, where a sequential reader stops at the first.

    ``members(manifest_id, ord, name, size, sha256, sha512, kind)`` lists what an archive holds; kind is
    ``file``, ``dir`` or anything else.
    """
    c = F.col
    head = (
        members.filter((c("name") == MANIFEST_NAME) & (c("kind") == "file"))
        .groupBy("manifest_id")
        .agg(F.min("ord").alias("_manifest_at"))
    )
    known = manifests.select("manifest_id", "format_version").join(head, "manifest_id", "left")
    about = known.select(
        "manifest_id",
        F.explode(
            rows_where(
                (c("_manifest_at").isNull(), F.struct(F.lit("").alias("name"), F.lit("no manifest").alias("failure"))),
                (
                    c("format_version") != MANIFEST_VERSION,
                    F.struct(F.lit(MANIFEST_NAME).alias("name"), F.lit("unsupported version").alias("failure")),
                ),
            )
        ).alias("f"),
    ).select("manifest_id", "f.*")

    payload = members.filter((c("kind") != "dir") & ~((c("name") == MANIFEST_NAME) & (c("kind") == "file")))
    listed = entries.select(
        "manifest_id",
        c("path").alias("name"),
        *[c(x).alias(f"e_{x}") for x in ("size", "sha256", "sha512")],
        F.lit(True).alias("_listed"),
    )
    both = payload.withColumn("_held", F.lit(True)).join(listed, ["manifest_id", "name"], "full_outer")
    both = both.join(head, "manifest_id", "left")
    held, in_list = c("_held").isNotNull(), c("_listed").isNotNull()
    unsafe = F.when(held, unsafe_bundle_name(c("name")))
    digests = (c("sha256") != c("e_sha256")) | (c("sha512") != c("e_sha512"))
    failures = F.array_compact(
        F.array(
            F.when(held & (c("kind") != "file"), "not a regular file"),
            unsafe,
            F.when(held & (c("_manifest_at").isNull() | (c("ord") < c("_manifest_at"))), "before the manifest"),
            F.when(held & ~in_list, "not listed"),
            F.when(held & in_list & (c("size") != c("e_size")), "size differs"),
            F.when(held & in_list & digests, "digest differs"),
            F.when(~held & in_list, "missing"),
        )
    )
    return about.unionByName(both.select("manifest_id", "name", F.explode(failures).alias("failure")))


# --- attestations -----------------------------------------------------------------------------------------
def attestation_bind(records: DataFrame, documents: DataFrame, verification: DataFrame) -> DataFrame:
    """Does a signed record still hold? Digest of the document, then the signature, then the artifact.

    ``records(attestation_id, doc_id, document_sha256, signed, signature_valid, artifact_id)``;
    ``documents(doc_id, sha256)``; ``verification(doc_id, artifact_id, verified)``. Whether a signature is
    valid is an input: keys and certificates are checked by a cryptographic library.
    """
    digests = documents.select("doc_id", F.col("sha256").alias("_actual"))
    rows = records.join(digests, "doc_id", "left").join(
        verification.select("doc_id", "artifact_id", "verified"), ["doc_id", "artifact_id"], "left"
    )
    c = F.col
    status = (
        F.when(~F.coalesce("signed", F.lit(False)), "unsigned")
        .when(c("_actual").isNull(), "document missing")
        .when(c("_actual") != c("document_sha256"), "document changed")
        .when(~F.coalesce("signature_valid", F.lit(False)), "signature invalid")
        .when(F.coalesce("artifact_id", F.lit("")) == "", "signature only")
        .when(F.coalesce("verified", F.lit(False)), "verified")
        .otherwise("claims no longer hold")
    )
    return rows.select("attestation_id", "doc_id", status.alias("status")).withColumn(
        "accepted", F.col("status").isin("verified", "signature only")
    )
