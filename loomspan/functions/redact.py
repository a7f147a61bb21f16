"""Redaction of secrets and personal data, and names of files that hold secrets. The patterns are this engine's own.

Expressions only; placeholders are no match of any pattern, so redacting twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECRET_FILES = (r"(?:.*/)?\.env(?:\..+)?", r".*\.(?:pem|key|p12|pfx|jks|keystore|ppk)", r"(?:.*/)?(?:secrets?|credentials?)\.(?:ya?ml|json|toml|ini)", r"(?:.*/)?(?:id_rsa|id_dsa|id_ecdsa|id_ed25519)", r"(?:.*/)?\.(?:netrc|pgpass|htpasswd|npmrc|pypirc)")
SECRETS = (
    ("PRIVATE_KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("AWS_KEY", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("GITHUB_TOKEN", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})"),
    ("SLACK_TOKEN", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("STRIPE_KEY", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("GOOGLE_KEY", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("JWT", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("URL_PASSWORD", r"(://)[^/\s:@\[]+:[^/\s:@\[]+(?=@)"),
    ("ASSIGNED_SECRET", r"(?i)(\b(?:password|passwd|secret|api_key|apikey|token)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_\-]{12,}"),
)
#: What stands in every text that one of the patterns above, or of those below, can match; other texts pass as they are.
MAYBE_SECRET = r"-----BEGIN|A[KS]IA[0-9A-Z]|gh[pousr]_|github_pat_|xox[abprs]-|[sr]k_(?:live|test)_|AIza|eyJ[A-Za-z0-9_-]{8}|://[^/\s:@\[]+:|(?i:passw(?:or)?d|secret|api_?key|token)\s{0,3}[=:]"
MAYBE_PERSONAL = r"@|[0-9][0-9 .()\-]{4,}[0-9]"
PERSONAL = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("IPV4", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"),
    ("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("PHONE", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}\b|\(?\b[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b"),
)
CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"


def is_secret_file(path: Column) -> Column:
    return F.lower(path).rlike("^(?:" + "|".join(SECRET_FILES) + ")$")


def _replaced(text: Column, patterns) -> tuple[Column, Column]:
    kinds = [F.when(text.rlike(p), F.lit(kind)) for kind, p in patterns]
    out = text
    for kind, p in patterns:
        kept = "$1" if kind in ("URL_PASSWORD", "ASSIGNED_SECRET") else ""
        out = F.regexp_replace(out, p, f"{kept}[REDACTED:{kind}]")
    return out, F.array_compact(F.array(*kinds))


def _only(maybe: str, text: Column, out: Column, kinds: Column) -> tuple[Column, Column]:
    """The patterns' work where one pass says that there may be any."""
    some = text.rlike(maybe)
    return F.when(some, out).otherwise(text), F.when(some, kinds).otherwise(F.array().cast("array<string>"))


def secrets(text: Column) -> tuple[Column, Column]:
    """(text without secrets, kinds found); null and empty texts pass."""
    return _only(MAYBE_SECRET, text, *_replaced(text, SECRETS))


def luhn(number: Column) -> Column:
    """Whether the digits of a number have a valid check sum."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(number, "[ -]", "")), ""), lambda d: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))
    twice = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(twice, F.lit(0), lambda a, d: a + d) % 10 == 0


def personal(text: Column) -> tuple[Column, Column]:
    """(text without personal data, kinds found): addresses, numbers, and card numbers with a valid check sum."""
    cards = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(CARD), F.lit(0))), luhn)
    some = F.size(F.coalesce(cards, F.array().cast("array<string>"))) > 0
    masked = F.aggregate(cards, text, lambda t, c: F.replace(t, c, F.lit("[REDACTED:CARD]")))
    out, kinds = _replaced(F.when(some, masked).otherwise(text), PERSONAL)
    return _only(MAYBE_PERSONAL, text, out, F.concat(F.when(some, F.array(F.lit("CARD"))).otherwise(F.array().cast("array<string>")), kinds))
