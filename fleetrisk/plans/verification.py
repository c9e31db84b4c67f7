"""Documents against the artifacts they claim to describe."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import verify
from ..sources import boms


def verify_documents(documents: DataFrame, artifacts: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """``checks``, ``summary`` and ``refused`` documents. Input ``documents(doc_id, artifact_id, body)``."""
    detected = boms.bom_detect(documents)
    cyclonedx = boms.bom_read_cyclonedx(detected.filter("kind = 'cyclonedx' AND error IS NULL"))
    spdx = boms.bom_read_spdx(detected.filter("kind = 'spdx' AND error IS NULL"))
    claims, documented = (a.unionByName(b) for a, b in zip(cyclonedx, spdx, strict=True))
    checks = verify.all_checks(claims, documented, artifacts, files)
    return {
        "checks": checks,
        "summary": verify.verify_summary(checks),
        "refused": detected.filter("error IS NOT NULL").select("doc_id", "artifact_id", "error"),
    }
