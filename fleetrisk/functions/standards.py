"""Elements of four published minimum-element lists, and where their values come from."""

from __future__ import annotations

# Standard, cluster and element as published, then the fact that answers it. ``= text`` is the same for
# every artifact, ``! reason`` is beyond what an artifact can disclose (``+ fact`` is added to the reason).
ELEMENTS = """
g7 | Metadata | SBOM author | = fleetrisk
g7 | Metadata | Timestamp | = generated per document
g7 | Metadata | Generation context | = post-build
g7 | Models | Model name | name
g7 | Models | Model version | version
g7 | Models | Model producer | maker_or_tool
g7 | Models | Model description | description
g7 | Models | Model hash value | primary_sha384
g7 | Models | Model hash algorithm | hash_algorithms
g7 | Models | Model license | license
g7 | Models | Model identifier | uuid
g7 | Models | Model properties | architecture
g7 | Models | Model input-output properties | io
g7 | Models | Model training properties | ! training
g7 | Models | Model external references | reference
g7 | Datasets | Dataset name | datasets
g7 | Datasets | Dataset hash value | ! dataset
g7 | Datasets | Dataset properties | ! dataset
g7 | System | Model dependencies | dependencies
g7 | System | System-level properties | ! deployment
g7 | Infrastructure | Compute and runtime environment | ! deployment
g7 | Security | Known vulnerabilities and findings | finding_summary
g7 | Security | Integrity verification | integrity
g7 | KPI | Performance indicators | ! evaluation
cert-in | AIBOM | Model Name | name
cert-in | AIBOM | Model Version | version
cert-in | AIBOM | Model Type | architecture
cert-in | AIBOM | Model Developer | maker
cert-in | AIBOM | Model Licensing Information | license
cert-in | AIBOM | Software Dependencies | dependencies
cert-in | AIBOM | ML Models and Algorithms | architecture
cert-in | AIBOM | Model Performance Metrics | ! evaluation
cert-in | AIBOM | Data Source | datasets
cert-in | AIBOM | Data Sets | datasets
cert-in | AIBOM | Hardware | ! hardware
cert-in | AIBOM | Security Requirements | finding_summary
cert-in | AIBOM | Input | inputs
cert-in | AIBOM | Output | outputs
cert-in | AIBOM | Intended Usage | ! intent
cert-in | AIBOM | Out of Scope Usage | ! intent
cert-in | AIBOM | Environmental Impact | ! training
cert-in | AIBOM | Vulnerabilities | finding_summary
cert-in | AIBOM | Attestations | integrity
bsi | SBOM | Creator of the SBOM | = fleetrisk
bsi | SBOM | Timestamp | = generated per document, UTC
bsi | SBOM | SBOM-URI | = urn:uuid, derived from the primary file digest
bsi | SBOM | Format and version | = CycloneDX 1.6 and SPDX 3.0.1
bsi | Component | Component creator | contact
bsi | Component | Component name | name
bsi | Component | Component version | version
bsi | Component | Filename of the component | primary_path
bsi | Component | Dependencies on other components | ! loader + component_set
bsi | Component | Distribution licences | license
bsi | Component | Hash value of the deployable component (SHA-512) | primary_sha512
bsi | Component | Executable property | executable
bsi | Component | Archive property | = no archive
bsi | Component | Structured property | = structured
bsi | Component | Source code URI | repo_url
bsi | Component | URI of the deployable form | download
bsi | Component | Other unique identifiers | other_identifier
bsi | Component | Original licences | original_license
cisa-2026 | Data Fields | Component Dependency Relationship | relationships
cisa-2026 | Data Fields | Component Hash Algorithm | hash_algorithms
cisa-2026 | Data Fields | Component Hash Value | primary_sha256
cisa-2026 | Data Fields | Component Identifiers | identifiers
cisa-2026 | Data Fields | Component License | license
cisa-2026 | Data Fields | Component Name | name
cisa-2026 | Data Fields | Component Producer | maker
cisa-2026 | Data Fields | Component Version | version
cisa-2026 | Data Fields | SBOM Author | = fleetrisk
cisa-2026 | Data Fields | SBOM Author Signature | ! signing
cisa-2026 | Data Fields | SBOM Data Format Name | = CycloneDX and SPDX
cisa-2026 | Data Fields | SBOM Data Format Version | = CycloneDX 1.6 or 1.7; SPDX 3.0.1
cisa-2026 | Data Fields | SBOM Generation Context | = post-build
cisa-2026 | Data Fields | SBOM Timestamp | = generated per document
cisa-2026 | Data Fields | SBOM Tool Name | = fleetrisk
cisa-2026 | Data Fields | SBOM Tool Version | = stamped into each document
cisa-2026 | Data Fields | SBOM Version | = 1
cisa-2026 | Practices and Processes | Accommodation of Updates to SBOM Data | ! process
cisa-2026 | Practices and Processes | Coverage | component_coverage
cisa-2026 | Practices and Processes | Distribution and Delivery | ! process
cisa-2026 | Practices and Processes | Explicitly Identifying Unknown Information | = unknown elements are reported as absent or out-of-scope with a reason
cisa-2026 | Practices and Processes | Frequency | ! process
cisa-2026 | Practices and Processes | Machine-Processable Data | = JSON: CycloneDX, SPDX 3.0.1 JSON-LD, SARIF
"""

REASONS = {
    "training": "no weights file records how it was trained",
    "dataset": "data is published apart from a model",
    "deployment": "belongs to the place where a model runs",
    "evaluation": "measured by tests, not by reading a file",
    "intent": "only a publisher can state it",
    "signing": "added once a document is complete",
    "process": "a practice of an organisation, not a fact of a file",
    "hardware": "no weights file names its hardware",
    "loader": "only a build knows what loads the model; its own files are ",
}


def element_rows() -> list[dict[str, str | None]]:
    """``standard, cluster, name, fact, text, note`` of every element; a note's fact is what is added to it."""
    rows = []
    for line in ELEMENTS.strip().splitlines():
        standard, cluster, name, answer = line.split(" | ")
        row = dict.fromkeys(("fact", "text", "note")) | {"standard": standard, "cluster": cluster, "name": name}
        if answer.startswith("= "):
            row["text"] = answer[2:]
        elif answer.startswith("! "):
            reason, _, added = answer[2:].partition(" + ")
            row |= {"note": REASONS[reason], "fact": added or None}
        else:
            row["fact"] = answer
        rows.append(row)
    return rows
