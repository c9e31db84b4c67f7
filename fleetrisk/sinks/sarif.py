"""SARIF 2.1.0 logs: one run per artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions.lookups import nullif_empty
from ..operators.skew import first_row_per_key
from . import parts as J
from . import streams as ST

SECTIONS = ["rules", "results"]
SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
FINGERPRINT = "fleetriskFinding/v1"


def _uri(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def sarif_nodes(profiles: DataFrame, findings: DataFrame) -> DataFrame:
    """Rules (the worst finding of each id) and results, both by severity and then id."""
    c = F.col
    rows = findings.withColumn("_rank", S.severity_rank(c("severity")))
    message = F.coalesce(nullif_empty(c("description")), c("title"))
    worst = first_row_per_key(rows, ["artifact_id", "id"], [c("_rank"), c("ord")])
    score = J.record(tags=S.finding_tags(c("category")), security__severity=S.security_score(c("severity")))
    rule = J.leaf(
        id=c("id"),
        name=S.rule_name(c("id")),
        shortDescription=J.record(text=c("title")),
        fullDescription=J.record(text=message),
        defaultConfiguration=J.record(level=S.sarif_level(c("severity"))),
        properties=score,
    )
    facts = profiles.select("artifact_id", "name", "primary_path", "primary_sha256")
    located = rows.join(facts, "artifact_id", "left")
    where = F.coalesce(nullif_empty(c("location")), nullif_empty(c("primary_path")), F.lit("model"))
    place = J.record(physicalLocation=J.record(artifactLocation=J.record(uri=_uri(where))))
    mark = S.fingerprint(nullif_empty(c("primary_sha256")), F.coalesce("name", F.lit("")), c("id"))
    entry = J.leaf(
        ruleId=c("id"),
        level=S.sarif_level(c("severity")),
        message=J.record(text=message),
        locations=F.array(place),
        partialFingerprints=J.record(**{FINGERPRINT: mark}),
    )
    # within a severity the id decides, then the scanner's order
    tie = F.concat("id", F.lit("\u0001"), F.lpad(c("ord").cast("string"), 20, "0"))
    return J.nodes(worst, "rules", c("_rank"), c("id"), rule).unionByName(
        J.nodes(located, "results", c("_rank"), tie, entry)
    )


def _document(generated_at: str, tool_version: str) -> Column:
    c = F.col
    empty = F.lit("[]")
    driver = J.splice(
        J.members(J.leaf(name=F.lit("fleetrisk"), version=F.lit(tool_version))),
        J.member("rules", F.coalesce(J.joined(c("rules")), empty)),
    )
    digests = {f"sha{b}": nullif_empty(c(f"primary_sha{b}")) for b in (256, 384, 512)}
    known = F.coalesce(*digests.values()).isNotNull()
    location = J.record(uri=_uri(F.coalesce(nullif_empty(c("primary_path")), F.lit("model"))))
    artifact = J.record(location=location, hashes=F.when(known, J.record(**digests)))
    invocation = J.record(executionSuccessful=F.lit(True), endTimeUtc=F.lit(generated_at))
    run = J.splice(
        J.member("tool", J.splice(J.member("driver", driver))),
        J.members(J.leaf(artifacts=F.array(artifact), invocations=F.array(invocation))),
        J.member("results", F.coalesce(J.joined(c("results")), empty)),
    )
    head = J.leaf(**{"$schema": F.lit(SCHEMA)}, version=F.lit("2.1.0"))
    return J.splice(J.members(head), J.member("runs", F.concat(F.lit("["), run, F.lit("]"))))


def emit_sarif(
    profiles: DataFrame, node_rows: DataFrame, generated_at: str, tool_version: str = "1.0", limit: int | None = None
) -> DataFrame:
    """``(artifact_id, document, large)``. ``node_rows`` comes from ``sarif_nodes``."""
    return J.assembled(profiles, node_rows, SECTIONS, _document(generated_at, tool_version), limit)


def sarif_pieces(profiles: DataFrame, node_rows: DataFrame, generated_at: str, tool_version: str = "1.0") -> DataFrame:
    """The documents of ``emit_sarif`` as pieces for ``streams.write``."""
    return ST.pieces(profiles, node_rows, [ST.Section(s) for s in SECTIONS], _document(generated_at, tool_version))
