"""Scanner reports to findings.

``reports(artifact_id, scanner, format, body)``: one row per report, NULL body when there was no output
file. Findings keep their position in the report as ``ord``. Counting and capping come afterwards, in
``operators.findings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions import values as V
from ..functions.lookups import nullif_empty
from ..operators.findings import FINDING_COLUMNS
from ..session import tolerate_repeated_keys

TRIVY = (
    "Results array<struct<Target:string,"
    "Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,"
    "Severity:string,Title:string,Description:string>>,"
    "Secrets:array<struct<RuleID:string,Category:string,Severity:string,Title:string,Match:string>>>>"
)
GRYPE = (
    "matches array<struct<vulnerability:struct<id:string,severity:string,description:string>,"
    "artifact:struct<name:string,version:string,locations:array<struct<path:string>>>>>"
)
TRUFFLEHOG = (
    "DetectorName string, Verified boolean, Raw string, "
    "SourceMetadata struct<Data:struct<Filesystem:struct<file:string,line:int>>>"
)
NATIVE = (
    "findings array<struct<id:string,title:string,severity:string,category:string,location:string,description:string>>, "
    "generated boolean"
)
REPORT = ["artifact_id", "scanner"]


def read_reports(spark: SparkSession, root: str, fmt: str, scanner: str) -> DataFrame:
    """Whole report files below ``root/<artifact_id>/`` as rows."""
    rows = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    artifact = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return rows.select(artifact.alias("artifact_id"), F.lit(scanner).alias("scanner"), F.lit(fmt).alias("format"), F.col("value").alias("body"))


def _blank(body: Column) -> Column:
    return S.strip(F.coalesce(body, F.lit(""))) == ""


def _lines(reports: DataFrame) -> DataFrame:
    line = S.strip(F.col("value"))
    rows = reports.select(*REPORT, F.posexplode(F.split("body", "\n")).alias("ord", "value"))
    return rows.withColumn("value", line)


def _rows(rows: DataFrame, **fields: Column) -> DataFrame:
    named = [(fields[c] if c in fields else F.col(c)).alias(c) for c in FINDING_COLUMNS]
    return rows.select(*named)


def clamav_lines(lines: DataFrame) -> DataFrame:
    """Infected files from report lines ``(artifact_id, scanner, ord, value)``.

    Takes lines rather than a report, so one huge log read with ``spark.read.text`` stays split.
    """
    body = F.regexp_replace("value", r" FOUND$", "")
    hits = lines.filter(F.endswith("value", F.lit(" FOUND"))).withColumn("_p", F.split(body, ": ", 2))
    hits = hits.filter(F.size("_p") == 2)
    return _rows(
        hits,
        id=F.col("_p")[1],
        title=F.lit("Malware signature match"),
        severity=F.lit("Critical"),
        category=F.lit("malware"),
        location=F.col("_p")[0],
        description=F.concat(F.lit("signature "), F.col("_p")[1]),
    )


def ingest_clamav(reports: DataFrame) -> DataFrame:
    return clamav_lines(_lines(reports.filter(F.col("format") == "clamav")))


def trufflehog_lines(lines: DataFrame) -> DataFrame:
    """Credentials from JSON lines; other lines and rows without a detector are passed over."""
    rows = lines.filter(F.startswith("value", F.lit("{"))).withColumn("j", F.from_json("value", TRUFFLEHOG))
    rows = rows.filter(F.coalesce("j.DetectorName", F.lit("")) != "")
    verified = F.coalesce("j.Verified", F.lit(False))
    place = F.col("j.SourceMetadata.Data.Filesystem")
    location = F.coalesce(place["file"], F.lit(""))
    return _rows(
        rows,
        id=F.col("j.DetectorName"),
        title=F.concat("j.DetectorName", F.lit(" credential")),
        severity=F.when(verified, "Critical").otherwise("High"),
        category=F.lit("secret"),
        location=F.when(place["line"] > 0, F.concat(location, F.lit(":"), place["line"])).otherwise(location),
        description=F.when(verified, "the credential is live").otherwise("a credential pattern matched"),
    )


def ingest_trufflehog(reports: DataFrame) -> DataFrame:
    return trufflehog_lines(_lines(reports.filter(F.col("format") == "trufflehog-json")))


def ingest_trivy(reports: DataFrame) -> DataFrame:
    """Vulnerabilities and secrets, in report order."""
    parsed = reports.filter(F.col("format") == "trivy-json").select(*REPORT, F.from_json("body", TRIVY).alias("j"))
    results = parsed.select(*REPORT, F.posexplode("j.Results").alias("_r", "r"))
    # a report lists a target's vulnerabilities first and its secrets after them
    v = results.select(*REPORT, "_r", F.col("r.Target").alias("_t"), F.posexplode("r.Vulnerabilities").alias("_i", "v"))
    s = results.select(*REPORT, "_r", F.col("r.Target").alias("_t"), F.posexplode("r.Secrets").alias("_i", "v"))

    def position(kind: int) -> Column:
        return (F.col("_r").cast("bigint") * 2 + kind) * 1_000_000_000 + F.col("_i")

    target = F.coalesce("_t", F.lit(""))
    fixed = nullif_empty(F.col("v.FixedVersion"))
    description = F.concat(
        F.coalesce("v.PkgName", F.lit("")),
        F.lit(" "),
        F.coalesce("v.InstalledVersion", F.lit("")),
        F.lit(" is affected"),
        F.coalesce(F.concat(F.lit("; fixed in "), fixed), F.lit("")),
    )
    vulnerabilities = _rows(
        v,
        ord=position(0),
        id=F.col("v.VulnerabilityID"),
        title=F.coalesce(nullif_empty(F.col("v.Title")), F.concat("v.VulnerabilityID", F.lit(" in "), "v.PkgName")),
        severity=S.severity_normalize(F.col("v.Severity")),
        category=F.lit("cve"),
        location=target,
        description=description,
    )
    secrets = _rows(
        s,
        ord=position(1),
        id=F.col("v.RuleID"),
        title=F.coalesce("v.Title", F.lit("")),
        severity=S.severity_normalize(F.col("v.Severity")),
        category=F.lit("secret"),
        location=target,
        description=F.lit("a secret pattern matched"),
    )
    return vulnerabilities.unionByName(secrets)


def ingest_grype(reports: DataFrame) -> DataFrame:
    parsed = reports.filter(F.col("format") == "grype-json").select(*REPORT, F.from_json("body", GRYPE).alias("j"))
    m = parsed.select(*REPORT, F.posexplode("j.matches").alias("ord", "m"))
    first = F.when(F.size("m.artifact.locations") > 0, F.coalesce(F.col("m.artifact.locations")[0]["path"], F.lit("")))
    return _rows(
        m,
        id=F.col("m.vulnerability.id"),
        title=F.concat("m.vulnerability.id", F.lit(" in "), F.coalesce("m.artifact.name", F.lit(""))),
        severity=S.severity_normalize(F.col("m.vulnerability.severity")),
        category=F.lit("cve"),
        location=F.coalesce(first, "m.artifact.name", F.lit("")),
        description=S.utf8_cut(F.coalesce("m.vulnerability.description", F.lit("")), V.GRYPE_DESCRIPTION_BYTES),
    )


def ingest_native(reports: DataFrame) -> DataFrame:
    """Reports in the engine's own shape."""
    own = reports.filter(F.col("format").isin(V.NATIVE_FORMATS))
    f = own.select(*REPORT, F.posexplode(F.from_json("body", NATIVE)["findings"]).alias("ord", "f"))
    return _rows(
        f,
        severity=S.severity_normalize(F.col("f.severity")),
        **{c: F.coalesce(f"f.{c}", F.lit("")) for c in ("id", "title", "category", "location", "description")},
    )


def ingest_spdx_sbom(reports: DataFrame) -> DataFrame:
    """A package list is evidence that one exists: it yields a status and no finding."""
    return report_status(reports.filter(F.col("format") == "syft-spdx"))


SHAPES = {"trivy-json": TRIVY, "grype-json": GRYPE, **dict.fromkeys(V.NATIVE_FORMATS, NATIVE)}


def _misshapen(body: Column, fmt: Column) -> Column:
    """Whether a member that a reader uses is of another kind, at any depth. Absent and null members are well."""
    wrong = F.lit(False)
    for name, schema in SHAPES.items():
        read = F.from_json(body, f"{schema}, _wrong string", {"columnNameOfCorruptRecord": "_wrong"})
        wrong = F.when(fmt == name, read["_wrong"].isNotNull()).otherwise(wrong)
    return F.coalesce(wrong, F.lit(False))


def report_status(reports: DataFrame) -> DataFrame:
    """State of every report: parsed, absent (no file, which is not clean) or error, and ``produced``.

    An unknown format, malformed JSON and JSON of another shape are errors; blank output is a clean report.
    """
    tolerate_repeated_keys(reports.sparkSession)
    body, fmt = F.col("body"), F.col("format")
    structured = ~fmt.isin("clamav", "trufflehog-json")
    is_object = F.startswith(F.schema_of_variant(F.try_parse_json("body")), F.lit("OBJECT"))
    malformed = structured & ~_blank(body) & (~F.coalesce(is_object, F.lit(False)) | _misshapen(body, fmt))
    state = (
        F.when(body.isNull(), "absent")
        .when(~fmt.isin(V.REPORT_FORMATS), "error")
        .when(malformed, "error")
        .otherwise("parsed")
    )
    detail = F.when(~fmt.isin(V.REPORT_FORMATS), F.concat(F.lit("unknown format "), fmt)).when(
        malformed, "malformed report"
    )
    produced = F.when(fmt.isin(V.NATIVE_FORMATS) & (state == "parsed"), F.from_json("body", NATIVE)["generated"])
    return reports.select(
        *REPORT, "format", state.alias("state"), F.when(state == "error", detail).alias("detail"), produced.alias("produced")
    )


READERS = [ingest_clamav, ingest_trivy, ingest_grype, ingest_trufflehog, ingest_native]


def ingest(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of all readable reports, and the status of every report.

    Reports in error yield no findings here; they stay visible in the status table for quarantine.
    """
    status = report_status(reports)
    findings = None
    for reader in READERS:
        found = reader(reports)
        findings = found if findings is None else findings.unionByName(found)
    return findings, status
