"""Closed vocabularies. Every operator takes its vocabulary as an argument; these are the defaults."""

# File-name patterns by regulation, first match wins.
REGULATION_PATTERNS = {
    "GDPR": ("gdpr", "general_data_protection", "general data protection"),
    "CCPA": ("ccpa", "california_consumer", "california consumer"),
    "HIPAA": ("hipaa", "health_insurance", "health insurance"),
    "NIST": ("nist", "cybersecurity_framework", "cybersecurity framework"),
}

# Keywords that name a jurisdiction.
JURISDICTION_KEYWORDS = {
    "GDPR": ("gdpr", "general data protection", "european union", "eu", "dpa", "data subject", "controller", "processor", "article 17", "right to erasure", "legitimate interest", "supervisory authority"),
    "CCPA": ("ccpa", "california consumer privacy", "california", "ccpr", "opt-out", "sale of personal information", "do not sell", "business purpose"),
    "HIPAA": ("hipaa", "health insurance portability", "protected health information", "phi", "covered entity", "business associate", "hitech", "minimum necessary"),
    "NIST": ("nist", "national institute", "cybersecurity framework", "nist sp", "csf", "identify", "protect", "detect", "respond", "recover", "id.im", "pr.ac", "de.cm", "rs.rp", "rc.rp"),
}

# Penalty caps.
PENALTY_CAPS = {
    "GDPR": "€20M or 4% of global annual turnover (whichever higher)",
    "CCPA": "$7,500 per intentional violation, $2,500 per unintentional",
    "HIPAA": "$100–$50,000 per violation category; $1.9M annual cap per category",
    "NIST": "No statutory fines — contractual / federal-procurement risk",
}

# Weights and scores.
REGULATION_WEIGHTS = {"GDPR": 0.35, "HIPAA": 0.30, "CCPA": 0.20, "NIST": 0.15}
DEFAULT_WEIGHT = 0.1
SEVERITY_SCORES = {"critical": 10.0, "high": 7.5, "medium": 5.0, "low": 2.5, "info": 1.0}
DEFAULT_SEVERITY_SCORE = 5.0
SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
TRACKER_WEIGHTS = {"critical": 10.0, "high": 7.0, "medium": 4.0, "low": 1.0}
RATINGS = ((85.0, "STRONG"), (65.0, "MODERATE"), (40.0, "WEAK"), (None, "CRITICAL"))

# Obligation types that are critical when missing.
CRITICAL_TYPES = ("breach_notification", "data_subject_rights", "lawful_basis", "data_retention", "access_control", "encryption", "dpo_appointment")

# Keywords by obligation type, first match wins.
OBLIGATION_KEYWORDS = {
    "breach_notification": ("breach", "notif", "incident", "72 hour", "72-hour", "report incident", "supervisory authority"),
    "data_subject_rights": ("right to", "erasure", "deletion", "right of access", "rectification", "object", "restriction", "subject access", "forgotten"),
    "data_portability": ("portability", "transmit", "machine-readable", "machine readable", "export"),
    "lawful_basis": ("lawful basis", "legitimate interest", "legal basis", "contract", "legal obligation", "purpose limitation", "necessity"),
    "data_retention": ("retention", "storage limitation", "delete", "purge", "retain", "destroy", "time limit"),
    "access_control": ("access control", "least privilege", "authenticat", "authoris", "authoriz", "role", "permission", "credential"),
    "encryption": ("encrypt", "cryptograph", "at rest", "in transit", "tls", "aes", "pseudonymi", "anonymi"),
    "dpo_appointment": ("data protection officer", "dpo", "privacy officer", "representative"),
    "audit_logging": ("audit", "logging", "monitor", "track", "record of processing", "recordkeeping", "documentation", "assessment"),
    "consent": ("consent", "opt-in", "opt out", "opt-out", "withdrawal", "agree"),
    "third_party_sharing": ("third part", "share", "disclos", "transfer", "vendor", "sub-processor", "subprocessor", "processor agreement"),
    "minor_consent": ("minor", "child", "parental", "under 13", "under 16", "age verif"),
}

# Signals in questions.
CROSS_DOCUMENT_SIGNALS = ("which polic", "which compan", "compare", "across", "all polic", "every polic", "each polic", "any polic", "these polic")
COVERAGE_SIGNALS = ("which polic", "which document", "which compan", "do any", "does any", "find policies", "find documents", "address", "mention", "cover", "discuss", "include", "have", "contain")
AUDIT_WORDS = ("comply", "complian", "gap", "violat", "miss", "fail", "audit")
FRESH_SIGNALS = ("latest", "recent", "today", "current", "2024", "2025", "news")
FILENAME_STOPWORDS = ("privacy", "policy", "policies", "latest", "pdf", "com", "the", "doc", "document", "data", "notice", "statement")

# Gap themes in order, and their labels.
GAP_THEMES = {
    "data_deletion_rights": "Data Deletion & Erasure Rights",
    "data_access_rights": "Data Access Rights",
    "data_portability": "Data Portability",
    "consent_mechanisms": "Consent Mechanisms",
    "opt_out_mechanisms": "Opt-Out Mechanisms",
    "data_retention": "Data Retention",
    "breach_notification": "Breach Notification",
    "third_party_sharing": "Third-Party Data Sharing",
    "security_measures": "Security Measures",
    "recordkeeping": "Recordkeeping & Documentation",
    "minor_consent": "Minors' Privacy & Consent",
    "regulatory_citations": "Regulatory Citations & References",
    "other": "Other Findings",
}

# Graph labels and relationship types.
NODE_LABELS = ("Regulation", "Article", "Obligation", "Right", "Entity", "Concept", "Penalty", "Timeframe")
RELATIONSHIPS = ("REFERENCES", "REQUIRES", "GRANTS", "CONFLICTS_WITH", "MAPS_TO", "STRICTER_THAN", "PART_OF", "DEFINES", "APPLIES_TO", "IMPOSES")
CONFLICT_RELATIONSHIPS = ("CONFLICTS_WITH", "STRICTER_THAN")

# Header patterns of articles by regulation, and where a table of contents ends.
ARTICLE_HEADERS = {
    "GDPR": r"\n(?:##\s+)?Article\s+\d+[a-z]?\s+[A-Z][^\n]{2,80}\n",
    "CCPA": r"(?m)^##\s+\*\*§\s*7\d{3}\.[^*\n]*\*\*",
    "HIPAA": r"(?m)^##\s+\*\*(?:§\s*\d+\.\d+|Subpart\s+[A-Z]|PART\s+\d+)[^*\n]*\*\*",
    "NIST": r"\*\*[A-Z]{2,3}\.[A-Z]{2,3}-P\d+\s*:\s*\*\*",
}
CONTENTS_END = {"HIPAA": r"(?i)##\s+\*\*Subpart\s+A"}
TABLE_REGULATIONS = ("NIST",)
# Fixed value: a misspelt name that documents come under.
REGULATION_SPELLINGS = {"HIPPA": "HIPAA"}

# Aliases of policy names, and replacements of company names.
POLICY_ALIASES = {
    "microsoft_privacy_policy.pdf": "privacy_policy_1.pdf",
    "meta_privacy_policy.pdf": "privacy_policy_2.pdf",
    "stripe_privacy_policy.pdf": "privacy_policy_3.pdf",
    "uber_privacy_policy.pdf": "privacy_policy_4.pdf",
    "salesforce_privacy_policy.pdf": "privacy_policy_5.pdf",
    "netflix_privacy_policy.pdf": "privacy_policy_6.pdf",
    "google_privacy_policy_latest.pdf": "privacy_policy_7.pdf",
    "zoom_privacy_policy.pdf": "privacy_policy_8.pdf",
}
COMPANY_NAMES = {"microsoft": "Policy 1", "meta": "Policy 2", "stripe": "Policy 3", "uber": "Policy 4", "salesforce": "Policy 5", "netflix": "Policy 6", "google": "Policy 7", "zoom": "Policy 8"}
