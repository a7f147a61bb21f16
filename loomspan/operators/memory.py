"""Memory of working sessions: turns, summaries, recall keys, timelines, decisions.

sessions, prompts and tool events are tables; nothing here keeps state of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.grammar import compressed
from ..functions.text import sentences
from ..sources.embed import hashed_vectors

AFFORDANCE = r"(?U)\s*·\s+(?:just now|[0-9]+[mhdy]o? ago|[0-9]+[mhd] ago)(?:\s*·\s+→\s+session_(?:timeline|event)\([^)]*\))?\s*$"


def numbered_prompts(turns: DataFrame) -> DataFrame:
    """Adds prompt_number to (session_id, at, role, text): users' turns count from 1, others have the last one's number."""
    w = Window.partitionBy("session_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("prompt_number", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).cast("bigint"))


def content_key(text: Column) -> Column:
    """A recall item without its tag, its time hint and articles."""
    body = F.regexp_replace(F.regexp_replace(text, r"^\[[^\]]*\]\s*", ""), AFFORDANCE, "")
    return compressed(F.trim(body), "lite")


SHOWN_FIELDS = ("file_path", "command", "pattern", "path", "query")


def quoted(text: Column) -> Column:
    """A text in quotes, double ones where it has single ones alone, with backslashes and line ends escaped."""
    for plain, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(shown))
    both = text.contains("'") & text.contains('"')
    single = F.concat(F.lit("'"), F.when(both, F.replace(text, F.lit("'"), F.lit("\\'"))).otherwise(text), F.lit("'"))
    return F.when(text.contains("'") & ~both, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(single)


def _shown(raw: Column, field: str) -> Column:
    """``field=value`` of a JSON object; null where it is missing, empty, zero or false. Lists and objects are shown as JSON."""
    value = F.get_json_object(raw, f"$.{field}")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{field}", "variant"))
    told = F.when(kind == "STRING", F.when(value != "", quoted(value))).when(kind == "BOOLEAN", F.when(value == "true", "True"))
    told = told.otherwise(F.when(~value.rlike(r"^(?:-?0+(?:\.0+)?|\[\]|\{\})$"), value))
    return F.concat(F.lit(f"{field}="), told)


def description(tool: Column, raw: Column) -> Column:
    """One line for a tool call: its name with the first telling field of its input, else the input's first two keys; with
    the input's beginning where that is long or no JSON object."""
    tool, raw = F.coalesce(tool, F.lit("")), F.coalesce(raw, F.lit(""))
    keys = F.when(F.length(raw) <= SETTINGS.input_chars, F.json_object_keys(raw))
    names = F.concat(F.lit("["), F.array_join(F.transform(F.slice(keys, 1, 2), quoted), ", "), F.lit("]"))
    told = F.concat_ws(" ", tool, F.coalesce(*(_shown(raw, f) for f in SHOWN_FIELDS), names))
    return F.when(raw == "", tool).when(keys.isNull(), F.concat(tool, F.lit(": "), F.substring(raw, 1, 120))).otherwise(told)


def turn_texts(prompts: DataFrame, events: DataFrame, payloads: DataFrame) -> DataFrame:
    """(session_id, prompt_number, text): the prompt, then each event's line and its output, cut, in order of id."""
    keys = ["session_id", "prompt_number"]
    output = F.trim(F.coalesce("raw_output", F.lit("")))
    cut = F.when(F.length(output) > SETTINGS.output_chars, F.concat(F.substring(output, 1, SETTINGS.output_chars), F.lit("…"))).otherwise(output)
    told = events.join(payloads.select(F.col("id").alias("payload_id"), "raw_input", "raw_output"), "payload_id", "left").withColumn("line", description(F.col("tool_name"), F.col("raw_input")))
    lines = told.withColumn("piece", F.when(cut != "", F.concat_ws("\n", "line", cut)).otherwise(F.col("line")))
    joined = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("pieces")).select(*keys, F.array_join(F.col("pieces.piece"), "\n").alias("events"))
    asked = prompts.select(*keys, F.when(F.col("prompt_text") != "", F.concat(F.lit("User: "), F.col("prompt_text"))).alias("prompt"))
    return asked.join(joined, keys, "full_outer").select(*keys, F.concat_ws("\n", "prompt", "events").alias("text"))


def central(parts: list[str], k: int, keep_order: bool = True) -> list[str]:
    """The k sentences nearest to the mean of all, in their own order (or of score)."""
    if len(parts) <= k:
        return parts
    v = hashed_vectors(parts).astype(float)
    mean = v.mean(axis=0)
    norm = np.linalg.norm(v, axis=1) * np.linalg.norm(mean)
    score = np.where(norm > 0, v @ mean / np.where(norm > 0, norm, 1), 0.0)
    best = np.argsort(-score, kind="stable")[:k]
    return [parts[i] for i in (sorted(best) if keep_order else best)]


def summaries(rows: DataFrame, text: str = "text", k: int = SETTINGS.turn_sentences) -> DataFrame:
    """Adds ``summary``: the k most central sentences in source order, or all if there are no more."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda parts: " ".join(central(list(parts), k)))

    return rows.withColumn("summary", run(F.coalesce(sentences(F.col(text)), F.array().cast("array<string>"))))


def tier(text: Column) -> Column:
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").otherwise("extractive")


def completed(sessions: DataFrame, prompts: DataFrame, ends: DataFrame) -> DataFrame:
    """Sessions with their counted prompts, and ended_at and status from end events (session_id, ts)."""
    counts = prompts.groupBy("session_id").agg(F.count("*").alias("prompt_count"))
    last = ends.groupBy("session_id").agg(F.max("ts").alias("ended_at"))
    own = sessions.join(counts, "session_id", "left").join(last, "session_id", "left")
    return own.withColumn("prompt_count", F.coalesce("prompt_count", F.lit(0))).withColumn("status", F.when(F.col("ended_at").isNotNull(), "completed").otherwise("active"))


def recent_decisions(decisions: DataFrame, limit: int) -> DataFrame:
    """The newest row of each decision text, newest first (``place`` from 1)."""
    w = Window.partitionBy("decision").orderBy(F.col("created").desc(), F.col("id"))
    newest = decisions.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return newest.orderBy(F.col("created").desc(), F.col("id")).limit(limit)


def first_decisions(rows: DataFrame) -> DataFrame:
    """(session_id, at, decision, reason): of decisions equal in any case the first of a session."""
    w = Window.partitionBy("session_id", F.lower("decision")).orderBy("at", "place")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def consolidated(files: DataFrame, most: int, keep: int) -> DataFrame:
    """Adds ``kept`` to session files (id, modified): all if there are ``most`` or fewer, else the newest ``keep``."""
    total = files.agg(F.count("*").alias("total"))
    newest = files.orderBy(F.col("modified").desc(), F.col("id").desc()).limit(keep).select("id", F.lit(True).alias("new"))
    return files.join(newest, "id", "left").join(F.broadcast(total)).withColumn("kept", F.coalesce("new", F.lit(False)) | (F.col("total") <= most)).drop("new", "total")


def areas_like(areas: DataFrame, topic: str, limit: int = 100) -> DataFrame:
    """Code areas whose path or description holds the topic in any case, newest first; % and _ stay wildcards."""
    like = f"%{topic}%"
    return areas.where(F.col("file_path").ilike(like) | F.col("description").ilike(like)).orderBy(F.col("created").desc(), F.col("id")).limit(limit)


def exported(decisions: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Decisions of since <= created < until, oldest first, each as a line of Markdown."""
    rows = decisions
    if since is not None:
        rows = rows.where(F.col("created") >= since)
    if until is not None:
        rows = rows.where(F.col("created") < until)
    day = F.date_format(F.timestamp_seconds("created"), "yyyy-MM-dd")
    return rows.orderBy("created", "id").select("id", "created", F.format_string("- **%s** (%s): %s", F.col("decision"), day, F.coalesce("reason", F.lit(""))).alias("markdown"))
