"""Token estimates, costs, clamps and number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LEVEL_SHARE, SETTINGS


def packed_tokens(content: Column, compressed: Column | None = None) -> Column:
    """max(1, floor(length / 3.3)) of the compressed text, of the content where that is null or empty."""
    text = content if compressed is None else F.coalesce(F.nullif(compressed, F.lit("")), content)
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / F.lit(3.3))).cast("bigint")


def counted_tokens(text: Column) -> Column:
    """max(1, length // 4)."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("bigint")


def memory_tokens(text: Column) -> Column:
    """As counted_tokens, but 0 for an empty text."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(0)).otherwise(counted_tokens(text)).cast("bigint")


def json_tokens(n_bytes: Column) -> Column:
    return F.floor(n_bytes / 6).cast("bigint")


def cost(tokens: Column, rate: Column) -> Column:
    """Price of tokens at a rate for a million."""
    return tokens * rate / F.lit(1e6)


def short_number(n: Column) -> Column:
    """1.2M, 3.4k or the number itself; ties go to the even digit."""

    def tenths(unit: int, name: str) -> Column:
        n_, step = n.cast("bigint"), unit // 10
        whole, rest = F.floor(n_ / step).cast("bigint"), F.pmod(n_, F.lit(step))
        up = (rest * 2 > step) | ((rest * 2 == step) & (F.pmod(whole, F.lit(2)) == 1))
        whole = whole + up.cast("bigint")
        return F.concat(F.floor(whole / 10).cast("string"), F.lit("."), F.pmod(whole, F.lit(10)).cast("string"), F.lit(name))

    return F.when(n >= 1_000_000, tenths(1_000_000, "M")).when(n >= 1_000, tenths(1_000, "k")).otherwise(n.cast("bigint").cast("string"))


def shown_cost(value: Column) -> Column:
    """Dollars with two places; empty below a cent."""
    return F.when(value < 0.01, F.lit("")).otherwise(F.format_string("$%.2f", value))


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default))))


def reply_saving(level: Column) -> Column:
    """Tokens that an output level is assumed to save on a reply; 0 for unknown levels."""
    share = F.lit(0.0)
    for name, value in LEVEL_SHARE.items():
        share = F.when(level == name, F.lit(value)).otherwise(share)
    return F.floor(share * SETTINGS.reply_tokens).cast("bigint")
