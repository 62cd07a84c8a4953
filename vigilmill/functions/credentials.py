"""Credentials in text by literal formats, in native columns; placeholders are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public token formats.
FORMATS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "url_password": r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@[^\s/]+",
    "assignment": r"(?i)\b(?:password|passwd|secret|token|api_?key) ?[=:] ?\"?[0-9a-z]{16,}\"?",
}
PLACEHOLDER = r"(?i)example|placeholder|changeme|your[_-]|xxxx|0000000000|\*{4}|<[a-z_ ]+>"


def credential_kinds(text: Column) -> Column:
    """Sorted kinds with a match that is not a placeholder."""
    found = [F.when(F.exists(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: ~m.rlike(PLACEHOLDER)), F.lit(k)) for k, p in FORMATS.items()]
    return F.array_sort(F.array_compact(F.array(*found)))


def scrubbed(text: Column) -> Column:
    """Every match replaced by its kind."""
    for kind, pattern in FORMATS.items():
        text = F.regexp_replace(text, pattern, f"<{kind}>")
    return text
