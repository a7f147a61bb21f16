"""Texts for readers: results with references, project overviews, recall headers, resumes and status lines.

Each takes tables and returns one row a query; rows that are joined to a text are bounded by earlier limits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import scoring
from ..functions.grammar import expanded
from ..functions.tokens import cost, shown_cost
from .memory import central
from .search import top

#: Files of editors and assistants that are no answer to a question about the code, and prefixes of such.
TOOL_FILES = ("CLAUDE.md",)
TOOL_PREFIXES = (".claude/", ".mcp.json", ".cursor/", ".cursorrules", ".vscode/mcp.json", ".gemini/", "GEMINI.md", ".codex/", "opencode.json", "opencode.jsonc")


def is_tool_file(path: Column) -> Column:
    hit = path.isin(*TOOL_FILES)
    for p in TOOL_PREFIXES:
        hit = hit | path.startswith(p)
    return hit


def watched(path: Column, ignored_names) -> Column:
    """Whether a changed path matters: no part of it is ignored."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ignored_names)))


def _joined(df: DataFrame, by: str, order: str, line: Column, name: str, sep: str = "\n") -> DataFrame:
    return df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x")))).alias("a")).select(by, F.array_join(F.col("a.x"), sep).alias(name))


def results(rows: DataFrame) -> DataFrame:
    """(query_id, text) of (query_id, rank, id, file_path, start_line, score, served, inline): texts, then references."""
    head = F.format_string("[%s:%d] (confidence: %.2f)\n%s", "file_path", "start_line", "score", "served")
    more = F.format_string('  expand_chunk(chunk_id="%s")  → %s:%d (confidence: %.2f)', F.col("id").cast("string"), F.col("file_path"), F.col("start_line"), F.col("score"))
    shown = _joined(rows.where("inline"), "query_id", "rank", head, "shown", "\n\n---\n\n")
    kept = rows.where("not inline")
    refs = _joined(kept, "query_id", "rank", more, "refs").join(kept.groupBy("query_id").count(), "query_id")
    tail = F.concat(F.format_string("\n---\n%d more result(s) available (not shown to save tokens):\n", F.col("count")), F.col("refs"))
    both = rows.select("query_id").distinct().join(shown, "query_id", "left").join(refs, "query_id", "left")
    return both.select("query_id", F.concat_ws("\n\n---\n\n", "shown", F.when(F.col("refs").isNotNull(), tail)).alias("text"))


def overview(chunks: DataFrame, project: str, commits: list[str] | None = None, decisions: list[str] | None = None, state: list[str] | None = None, max_tokens: int = 10_000) -> DataFrame:
    """One row: a project document of confident chunks by file, others as pointers, cut at the token limit.

    chunks: id, file_path, content, compressed_content, confidence_score, rank; a search's bounded result.
    """
    own = chunks.withColumn("level", scoring.level(F.col("confidence_score"))).withColumn("short", F.nullif(F.coalesce("compressed_content", F.lit("")), F.lit("")))
    high = own.where("level = 'high'").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.coalesce("short", F.substring("content", 1, 200))).alias("x")))).alias("a"))
    files = high.select(F.lit(1).alias("k"), "file_path", F.concat(F.lit("\n**"), "file_path", F.lit(":**\n"), F.array_join(F.col("a.x"), "\n")).alias("x"))
    arch = _joined(files, "k", "file_path", F.col("x"), "arch")
    medium = top(own.where("level = 'medium'").withColumn("k", F.lit(1)), 20, [F.col("rank"), F.col("id")], "k", "n")
    rest = _joined(medium, "k", "n", F.concat(F.lit("- ["), "file_path", F.lit("] "), F.coalesce("short", F.substring("content", 1, 150))), "rest")
    listed = lambda items, none: "\n".join(f"- {x}" for x in items) if items else none
    count = own.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    doc = F.concat_ws(
        "\n\n",
        F.concat(F.lit(f"## Project: {project}\n`"), F.when(F.col("n") > 0, F.format_string("%d chunks indexed", "n")).otherwise("no chunks indexed yet"), F.lit("`")),
        F.concat(F.lit("### Architecture\n"), F.coalesce("arch", F.lit("No indexed context available yet."))),
        F.lit("### Recent Activity\n" + listed((commits or [])[:10], "No recent commits.")),
        F.lit("### Working State\n" + "\n".join(f"  {x}" for x in state)) if state else F.lit(None),
        F.lit("### Active Context\n" + listed(decisions, "")) if decisions else F.lit(None),
        F.concat(F.lit("### Additional Context (may need drill-down)\n"), F.col("rest")),
    )
    most = max_tokens * 4
    rows = count.join(arch, "k", "left").join(rest, "k", "left").select(doc.alias("text"))
    return rows.select(F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("\n\n[Context truncated to fit token limit]"))).otherwise(F.col("text")).alias("text"))


def merged_searches(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of one search, then those of another with other ids; both have (id, rank)."""
    fresh = second.join(first.select("id"), "id", "left_anti")
    return first.withColumn("list", F.lit(0)).unionByName(fresh.withColumn("list", F.lit(1)))


def recall_text(hits: DataFrame, shown: int = SETTINGS.recall_shown, pool: int = SETTINGS.summary_pool) -> DataFrame:
    """(query_id, text) of ranked hits (query_id, topic, rank, key, text): the three most central keys, then the hits."""
    kept = hits.where(F.col("rank") < shown)

    @F.pandas_udf("array<string>")
    def heads(keys: pd.Series) -> pd.Series:
        return keys.map(lambda own: central([k for k in list(own)[:pool] if k], 3, keep_order=False) if len(own) >= 3 else [])

    row = F.struct("rank", "key", F.concat(F.lit("- "), "text").alias("x"))
    own = kept.groupBy("query_id", "topic").agg(F.array_sort(F.collect_list(row)).alias("a")).join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    own = own.withColumn("head", heads(F.col("a.key")))
    body = F.array_join(F.col("a.x"), "\n")
    title = F.concat(F.lit("TL;DR ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " match for '").otherwise(" matches for '"), F.col("topic"), F.lit("'):\n"))
    tldr = F.concat(title, F.array_join(F.transform("head", lambda h: F.concat(F.lit("  • "), h)), "\n"), F.lit("\n\nSource matches:\n"), body)
    return own.select("query_id", F.when(F.size("head") > 0, tldr).otherwise(body).alias("text"))


def substring_fallback(ranked: DataFrame, items: DataFrame, queries: DataFrame) -> DataFrame:
    """For queries (query_id, topic) without any ranked row: items (key, text) that hold the topic in any case."""
    empty = queries.join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    return items.join(F.broadcast(empty.limit(10_000)) if empty.limit(10_001).count() <= 10_000 else empty, F.lower("text").contains(F.lower("topic"))).select("query_id", "topic", "key", "text")


def resume(sessions: DataFrame, decisions: DataFrame, n: int = 5, reason_chars: int = 200) -> DataFrame:
    """One row: the latest non-empty rollup and the newest decisions with cut reasons, as words again.

    sessions: started, ended, rollup. decisions: id, created, decision, reason, source, session_id.
    """
    last = sessions.where("rollup is not null and rollup <> ''").orderBy(F.col("started").desc()).limit(1)
    roll = last.select(F.lit(1).alias("k"), F.concat(F.lit("**Previous session** ("), F.coalesce("ended", F.lit("in progress")), F.lit("):\n  "), expanded(F.trim("rollup"))).alias("roll"))
    newest = top(decisions.withColumn("k", F.lit(1)), n, [F.col("created").desc(), F.col("id")], "k", "n")
    cut = F.when(F.length("reason") > reason_chars, F.concat(F.substring("reason", 1, reason_chars), F.lit("…"))).otherwise(F.coalesce("reason", F.lit("")))
    tag = F.when(F.col("source") != "manual", F.concat(F.lit(" _["), "source", F.lit("]_"))).otherwise("")
    hint = F.when(F.col("session_id").isNotNull(), F.concat(F.lit(" (session: `"), "session_id", F.lit("`)"))).otherwise("")
    told = newest.withColumn("decision", expanded(F.trim("decision"))).withColumn("reason", expanded(cut))
    line = F.concat(F.lit("  - "), "decision", F.lit(" — "), "reason", tag, hint)
    made = _joined(told.withColumn("x", line), "k", "n", F.col("x"), "made")
    return roll.join(made, "k", "full_outer").select(F.concat_ws("\n\n", "roll", F.concat(F.lit("**Recent decisions** (most-recent first):\n"), F.col("made"))).alias("text"))


def status(stats: DataFrame, rate: float) -> DataFrame:
    """(text) of (queries, raw, served, full_file): savings against whole files if known, else against raw chunks."""
    base = F.when(F.col("full_file") > 0, F.col("full_file")).otherwise(F.col("raw"))
    saved = F.greatest(base - F.col("served"), F.lit(0))
    pct = F.when(base > 0, F.floor(100 * saved / F.greatest(base, F.lit(1)))).otherwise(0).cast("int")
    money = F.nullif(shown_cost(cost(saved, F.lit(rate))), F.lit(""))
    kind = F.when(F.col("full_file") > 0, "full-file baseline").otherwise("raw")
    text = F.concat(F.format_string("Token savings (%d queries): ", "queries"), F.format_number(base, 0), F.lit(" "), kind, F.lit(" → "), F.format_number("served", 0), F.lit(" served ("), pct.cast("string"), F.lit("% saved"), F.coalesce(F.concat(F.lit(", "), money), F.lit("")), F.lit(")"))
    return stats.select(F.when(F.col("queries") > 0, text).otherwise("Token savings: waiting for the first search.").alias("text"))
