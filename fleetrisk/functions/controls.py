"""Control catalogues, evidence kinds and attack techniques.

Identifiers, automation levels and evidence kinds are published facts and mappings that must match; the
reasons are our own words.
"""

EVIDENCE_KINDS = [
    "inventory", "security-scan", "sbom", "aibom", "provenance", "secrets", "policy", "verdict",
    "risk-score", "residual-risk", "scan-history", "revocation", "coverage-gap", "bias-eval",
]

AI_RMF = "nist-ai-rmf-1.0"
SP_800_53 = "nist-sp-800-53r5"

# control: (automation, evidence)
AI_RMF_CONTROLS = {
    "GOVERN 1.1": ("None", []),
    "GOVERN 1.2": ("Partial", ["policy"]),
    "GOVERN 1.3": ("Partial", ["policy"]),
    "GOVERN 1.4": ("Partial", ["policy", "verdict"]),
    "GOVERN 1.5": ("Partial", ["scan-history"]),
    "GOVERN 1.6": ("Full", ["inventory", "risk-score"]),
    "GOVERN 1.7": ("Partial", ["revocation"]),
    "GOVERN 2.1": ("None", []),
    "GOVERN 2.2": ("None", []),
    "GOVERN 2.3": ("None", []),
    "GOVERN 3.1": ("None", []),
    "GOVERN 3.2": ("None", []),
    "GOVERN 4.1": ("None", []),
    "GOVERN 4.2": ("Partial", ["security-scan", "risk-score"]),
    "GOVERN 4.3": ("Partial", ["security-scan"]),
    "GOVERN 5.1": ("None", []),
    "GOVERN 5.2": ("None", []),
    "GOVERN 6.1": ("Partial", ["sbom", "policy"]),
    "GOVERN 6.2": ("Partial", ["verdict", "revocation"]),
    "MAP 1.1": ("None", []),
    "MAP 1.2": ("None", []),
    "MAP 1.3": ("None", []),
    "MAP 1.4": ("None", []),
    "MAP 1.5": ("Partial", ["policy"]),
    "MAP 1.6": ("None", []),
    "MAP 2.1": ("Partial", ["inventory", "aibom"]),
    "MAP 2.2": ("None", []),
    "MAP 2.3": ("None", []),
    "MAP 3.1": ("None", []),
    "MAP 3.2": ("None", []),
    "MAP 3.3": ("None", []),
    "MAP 3.4": ("None", []),
    "MAP 3.5": ("Partial", ["residual-risk"]),
    "MAP 4.1": ("Partial", ["sbom"]),
    "MAP 4.2": ("Full", ["policy", "security-scan"]),
    "MAP 5.1": ("None", []),
    "MAP 5.2": ("None", []),
    "MEASURE 1.1": ("Full", ["policy", "coverage-gap"]),
    "MEASURE 1.2": ("None", []),
    "MEASURE 1.3": ("None", []),
    "MEASURE 2.1": ("Partial", ["security-scan", "policy"]),
    "MEASURE 2.2": ("None", []),
    "MEASURE 2.3": ("None", []),
    "MEASURE 2.4": ("None", []),
    "MEASURE 2.5": ("None", []),
    "MEASURE 2.6": ("Partial", ["risk-score", "residual-risk"]),
    "MEASURE 2.7": ("Full", ["security-scan", "secrets", "sbom"]),
    "MEASURE 2.8": ("Partial", ["provenance", "inventory"]),
    "MEASURE 2.9": ("None", []),
    "MEASURE 2.10": ("Partial", ["secrets"]),
    "MEASURE 2.11": ("None", ["bias-eval"]),
    "MEASURE 2.12": ("None", []),
    "MEASURE 2.13": ("None", []),
    "MEASURE 3.1": ("Partial", ["scan-history"]),
    "MEASURE 3.2": ("Partial", ["coverage-gap"]),
    "MEASURE 3.3": ("None", []),
    "MEASURE 4.1": ("None", []),
    "MEASURE 4.2": ("None", []),
    "MEASURE 4.3": ("None", []),
    "MANAGE 1.1": ("Partial", ["verdict"]),
    "MANAGE 1.2": ("Full", ["risk-score", "security-scan"]),
    "MANAGE 1.3": ("Full", ["verdict", "residual-risk"]),
    "MANAGE 1.4": ("Full", ["residual-risk", "coverage-gap"]),
    "MANAGE 2.1": ("None", []),
    "MANAGE 2.2": ("None", []),
    "MANAGE 2.3": ("Partial", ["scan-history", "revocation"]),
    "MANAGE 2.4": ("Partial", ["revocation", "verdict"]),
    "MANAGE 3.1": ("Full", ["scan-history", "policy", "sbom"]),
    "MANAGE 3.2": ("Full", ["scan-history", "inventory", "security-scan"]),
    "MANAGE 4.1": ("Partial", ["scan-history", "residual-risk", "revocation"]),
    "MANAGE 4.2": ("None", []),
    "MANAGE 4.3": ("Partial", ["verdict"]),
}
SP_800_53_CONTROLS = {
    "SR-4": ("Partial", ["provenance", "inventory"]),
    "SR-11": ("Partial", ["provenance"]),
    "SR-10": ("Full", ["security-scan", "coverage-gap"]),
    "SR-3": ("Partial", ["policy", "verdict", "residual-risk"]),
    "RA-5": ("Full", ["security-scan", "scan-history", "coverage-gap"]),
    "SI-3": ("Partial", ["security-scan"]),
    "SI-7": ("Full", ["provenance", "verdict"]),
    "SI-2": ("Partial", ["security-scan", "residual-risk"]),
    "CM-8": ("Full", ["inventory", "sbom"]),
    "CM-14": ("Full", ["provenance", "verdict"]),
    "CM-7": ("Partial", ["security-scan", "policy"]),
    "AU-2": ("Full", ["scan-history", "residual-risk", "revocation"]),
    "AU-3": ("Full", ["residual-risk", "verdict"]),
    "AU-9": ("Partial", ["residual-risk"]),
    "AC-3": ("Partial", ["policy"]),
    "AC-6": ("Partial", ["policy"]),
    "CA-7": ("Partial", ["scan-history", "verdict"]),
    "CA-2": ("Partial", ["verdict", "coverage-gap"]),
    "SA-11": ("None", []),
    "SA-15": ("None", []),
    "RA-3": ("None", []),
}
REASONS = {
    "Full": "the evidence listed is enough for this control",
    "Partial": "the evidence listed supports part of this control; the rest is organizational",
    "None": "an organizational control: only a named attestation can support it",
}


def catalog(framework: str) -> list[dict]:
    """Controls of a framework in their published order."""
    source = {AI_RMF: AI_RMF_CONTROLS, SP_800_53: SP_800_53_CONTROLS}
    if framework not in source:
        raise ValueError(f"unknown framework {framework!r}: use {', '.join(source)}")
    separator = " " if framework == AI_RMF else "-"
    rows = []
    for position, (control, (automation, evidence)) in enumerate(source[framework].items()):
        function = control.split(separator)[0]
        rows.append(
            {
                "framework": framework,
                "control_id": control,
                "position": position,
                "function": function,
                "category": control.split(".")[0] if framework == AI_RMF else function,
                "automation": automation,
                "evidence": evidence,
                "reason": REASONS[automation],
            }
        )
    return rows


TRAITS = {
    "valid": "Valid and Reliable",
    "safe": "Safe",
    "secure": "Secure and Resilient",
    "accountable": "Accountable and Transparent",
    "explainable": "Explainable and Interpretable",
    "privacy": "Privacy-Enhanced",
    "fair": "Fair with Harmful Bias Managed",
}

# technique: (name, tactic, coverage, evidence, mitigations)
TECHNIQUES = {
    "AML.T0011.000": ("Unsafe AI Artifacts", "Execution", "Detected", ["AR-PICKLE", "AR-KERAS", "AR-TF", "model-inspector"], ["AML.M0011", "AML.M0013", "AML.M0014", "AML.M0016"]),
    "AML.T0018.002": ("Embed Malware", "AI Attack Staging", "Detected", ["AR-PICKLE", "clamav", "model-inspector"], ["AML.M0013"]),
    "AML.T0112.001": ("Machine Compromise: AI Artifacts", "Impact", "Detected", ["AR-PICKLE", "clamav"], ["AML.M0011", "AML.M0016"]),
    "AML.T0011.001": ("Malicious Package", "Execution", "Detected", ["trivy", "grype", "syft"], ["AML.M0011", "AML.M0016"]),
    "AML.T0076": ("Corrupt AI Model", "Defense Evasion", "Detected", ["AR-COVERAGE", "AR-PICKLE"], ["AML.M0016"]),
    "AML.T0010": ("AI Supply Chain Compromise", "Initial Access", "Partial", ["AR-PROV", "AR-PICKLE", "clamav"], ["AML.M0014", "AML.M0023", "AML.M0035"]),
    "AML.T0010.003": ("AI Supply Chain Compromise: Model", "Initial Access", "Partial", ["AR-PROV", "AR-PICKLE"], ["AML.M0008", "AML.M0013", "AML.M0017"]),
    "AML.T0010.001": ("AI Supply Chain Compromise: AI Software", "Initial Access", "Partial", ["trivy", "grype", "syft"], ["AML.M0014", "AML.M0023"]),
    "AML.T0018.001": ("Modify AI Model Architecture", "AI Attack Staging", "Partial", ["AR-ONNX", "model-inspector"], ["AML.M0008"]),
    "AML.T0018.003": ("Modify Prompt Construction Logic", "AI Attack Staging", "OutOfScope", [], []),
    "AML.T0074": ("Masquerading", "Defense Evasion", "Partial", ["AR-BIN"], ["AML.M0014"]),
    "AML.T0115.001": ("Publish Poisoned AI Artifacts: Models", "Resource Development", "Partial", ["AR-PICKLE", "clamav", "AR-PROV"], ["AML.M0008", "AML.M0016"]),
    "AML.T0018.000": ("Poison AI Model", "AI Attack Staging", "OutOfScope", [], ["AML.M0007", "AML.M0008", "AML.M0025"]),
    "AML.T0020": ("Training Data Poisoning", "Resource Development", "OutOfScope", [], ["AML.M0007", "AML.M0025"]),
    "AML.T0043.004": ("Craft Adversarial Data: Insert Backdoor Trigger", "AI Attack Staging", "OutOfScope", [], ["AML.M0007", "AML.M0008"]),
    "AML.T0031": ("Erode AI Model Integrity", "Impact", "OutOfScope", [], ["AML.M0003", "AML.M0015"]),
    "AML.T0024": ("Exfiltration via AI Inference API", "Exfiltration", "OutOfScope", [], ["AML.M0004", "AML.M0005"]),
    "AML.T0051": ("LLM Prompt Injection", "Defense Evasion", "OutOfScope", [], ["AML.M0020", "AML.M0033"]),
    "AML.T0070": ("RAG Poisoning", "Persistence", "OutOfScope", [], ["AML.M0030", "AML.M0033"]),
    "AML.T0109": ("AI Supply Chain Rug Pull", "Resource Development", "OutOfScope", [], []),
    "AML.T0111": ("AI Supply Chain Reputation Inflation", "Resource Development", "OutOfScope", [], []),
    "AML.T0044": ("Full AI Model Access", "AI Model Access", "OutOfScope", [], ["AML.M0005", "AML.M0019"]),
    "AML.T0012": ("Valid Accounts", "Initial Access", "OutOfScope", [], ["AML.M0005", "AML.M0019"]),
}
RETIRED_TECHNIQUES = {
    "AML.T0019": "AML.T0115.000",
    "AML.T0058": "AML.T0115.001",
    "AML.T0104": "AML.T0115.002",
    "AML.T0045": "AML.T0048.004",
}
MITIGATIONS = {
    "AML.M0003": "Predictive AI Model Hardening",
    "AML.M0004": "Limit AI Service Query Volume and Rate",
    "AML.M0005": "Control Access to AI Models and Data at Rest",
    "AML.M0007": "Sanitize Training Data",
    "AML.M0008": "Validate AI Model",
    "AML.M0011": "Restrict Library Loading",
    "AML.M0013": "Code Signing",
    "AML.M0014": "Verify AI Artifacts",
    "AML.M0015": "Predictive AI Adversarial Input Detection",
    "AML.M0016": "Vulnerability Scanning",
    "AML.M0017": "AI Model Distribution Methods",
    "AML.M0019": "Control Access to AI Models and Data in Production",
    "AML.M0020": "Generative AI Guardrails",
    "AML.M0023": "AI Bill of Materials",
    "AML.M0025": "Maintain AI Dataset Provenance",
    "AML.M0030": "Restrict AI Agent Tool Invocation on Untrusted Data",
    "AML.M0033": "Input and Output Validation for AI Agent Components",
    "AML.M0035": "AI Red Team",
}
