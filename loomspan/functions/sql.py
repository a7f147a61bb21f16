"""Text functions under names that SQL can call, for one session.

What SQL can say is a temporary SQL function, which Catalyst inlines; only grammar and decisions are vectorised Python.
Nulls stay null, but for ``decisions_in``, which has no decisions for a null text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import decisions, grammar
from .text import IDENTIFIER_PATTERNS, TRUNCATION

_NAMES = "w -> length(w) >= 3 AND w NOT IN ({})"
_KEPT = _NAMES.format("'self', 'None', 'True', 'False'")
_PARAMETERS = _NAMES.format("'self', 'cls', 'None', 'True', 'False'")
_FOUND = ", ".join(f"regexp_extract_all(code, r'{p}', 1)" for p in IDENTIFIER_PATTERNS)
_LIMIT = "CASE level " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in TRUNCATION.items()) + " ELSE 300 END"

#: Heads and bodies of the functions that SQL expresses; a later one may call an earlier one.
SQL_FUNCTIONS = {
    "compression_ratio(original STRING, small STRING) RETURNS DOUBLE": "CASE WHEN length(original) = 0 THEN 0D ELSE 1 - length(small) / greatest(length(original), 1) END",
    "fallback_text(content STRING, level STRING) RETURNS STRING": f"CASE WHEN length(content) <= {_LIMIT} THEN content ELSE concat(substr(content, 1, {_LIMIT}), '...') END",
    "code_identifiers(code STRING) RETURNS ARRAY<STRING>": (
        f"array_sort(array_distinct(concat(filter(concat({_FOUND}), {_KEPT}), "
        r"filter(transform(flatten(transform(regexp_extract_all(code, r'(?:def|function)\s+\w+\s*\(([^)]*)\)', 1), p -> split(p, r'[,\s]+'))), "
        f"p -> trim(substring_index(substring_index(p, ':', 1), '=', 1))), {_PARAMETERS}), "
        r"regexp_extract_all(code, r'(?U)\b([A-Z][a-zA-Z0-9]+)\b', 1))))"
    ),
    "keeps_identifiers(code STRING, summary STRING) RETURNS BOOLEAN": (
        "CASE WHEN size(code_identifiers(code)) = 0 THEN true "
        "ELSE size(filter(code_identifiers(code), w -> contains(lower(summary), lower(w)))) / greatest(size(code_identifiers(code)), 1) >= 0.4 END"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""

    @F.pandas_udf("string")
    def grammar_compress(text: pd.Series, level: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else grammar.compress(x, y or "full") for x, y in zip(text, level)], dtype="object")

    @F.pandas_udf("string")
    def grammar_expand(text: pd.Series) -> pd.Series:
        return text.map(grammar.expand, na_action="ignore")

    @F.pandas_udf(decisions.DECISION)
    def decisions_in(text: pd.Series) -> pd.Series:
        return pd.Series([[{"decision": d, "reason": r} for d, r in decisions.decisions(x or "")] for x in text], dtype="object")

    own = {"grammar_compress": grammar_compress, "grammar_expand": grammar_expand, "decisions_in": decisions_in}
    for name, run in own.items():
        spark.udf.register(name, run)
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [*own, *(head.split("(")[0] for head in SQL_FUNCTIONS)]
