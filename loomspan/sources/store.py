"""JSON and configuration sources and sinks: manifests, sessions, legacy records, prices, status lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings

SESSION = (
    "id string, project string, started_at double, decisions array<struct<decision:string,reason:string,timestamp:double>>, "
    "code_areas array<struct<file_path:string,description:string,timestamp:double>>, questions array<string>, touched_files map<string,bigint>, _corrupt_record string"
)
#: Dollars for a million tokens of input and output.
PRICES = (
    ("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.6), ("gpt-4.1", 2.0, 8.0), ("gpt-4.1-mini", 0.4, 1.6), ("gpt-4.1-nano", 0.1, 0.4),
    ("o3", 2.0, 8.0), ("o3-mini", 1.1, 4.4), ("o4-mini", 1.1, 4.4), ("codex-mini", 1.5, 6.0),
    ("gemini-2.5-pro", 1.25, 10.0), ("gemini-2.5-flash", 0.15, 0.6), ("gemini-2.0-flash", 0.1, 0.4),
    ("opus", 15.0, 75.0), ("sonnet", 3.0, 15.0), ("haiku", 0.8, 4.0),
)
FALLBACK = "opus"


def sessions(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Session files with their time of change, newest first if limited; corrupt ones are skipped."""
    raw = spark.read.schema(SESSION).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = raw.select("*", F.col("_metadata.file_path").alias("file"), F.unix_timestamp("_metadata.file_modification_time").alias("modified"))
    rows = rows.where("_corrupt_record is null and id is not null").drop("_corrupt_record")
    return rows if newest is None else rows.orderBy(F.col("modified").desc(), F.col("file").desc()).limit(newest)


def legacy_decisions(session_rows: DataFrame, migrated: DataFrame) -> DataFrame:
    """Decisions of session files not migrated before (file), with source 'migrated'."""
    fresh = session_rows.join(migrated.select("file").distinct(), "file", "left_anti")
    return fresh.select("file", F.col("id").alias("session_id"), F.explode("decisions").alias("d")).select("file", "session_id", "d.decision", "d.reason", F.lit("migrated").alias("source"), F.col("d.timestamp").cast("bigint").alias("created"))


def manifest(spark: SparkSession, text: str | None) -> DataFrame:
    """(file_path, content_hash) of a manifest's JSON text, plain or with a ``files`` object; empty if unreadable."""
    import json

    try:
        data = json.loads(text or "{}")
        files = data.get("files", data) if isinstance(data, dict) else {}
        rows = [(k, v) for k, v in files.items() if isinstance(v, str) and not (files is data and k in ("schema_version", "last_git_sha"))]
    except ValueError:
        rows = []
    return spark.createDataFrame(rows, "file_path string, content_hash string")


def settings(*layers: dict) -> Settings:
    """Settings of layers, a later one over an earlier one; unknown names and wrong types are refused."""
    own = SETTINGS
    for layer in layers:
        own = own.with_overrides(**(layer or {}))
    return own


def prices(spark: SparkSession, overrides: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """(model, input_rate, output_rate), each field overridden where a value is given."""
    table = {m: (i, o) for m, i, o in PRICES}
    for model, pair in (overrides or {}).items():
        base = table.get(model, table[FALLBACK])
        table[model] = tuple(float(b if v is None else v) for v, b in zip(pair, base))
    return spark.createDataFrame([(m, i, o) for m, (i, o) in table.items()], "model string, input_rate double, output_rate double")


def priced(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (model) with their rates; unknown models have the fallback's."""
    base = table.where(F.col("model") == FALLBACK).select(F.col("input_rate").alias("__i"), F.col("output_rate").alias("__o"))
    own = rows.join(F.broadcast(table), "model", "left").join(F.broadcast(base))  # a few rows
    return own.withColumn("input_rate", F.coalesce("input_rate", "__i")).withColumn("output_rate", F.coalesce("output_rate", "__o")).drop("__i", "__o")


def audit_lines(results: DataFrame) -> DataFrame:
    """One JSON line a query of (query_id, text, ref, score): hashed text, references, range of scores."""
    own = results.groupBy("query_id", "text").agg(F.array_sort(F.collect_list("ref")).alias("refs"), F.min("score").alias("low"), F.max("score").alias("high"))
    return own.select(F.to_json(F.struct("query_id", F.substring(F.sha2("text", 256), 1, 12).alias("query"), "refs", "low", "high")).alias("value"))


def latest_sessions(rows: DataFrame, limit: int) -> DataFrame:
    """The newest sessions (session_id, started)."""
    limit = max(1, min(500, limit))
    return rows.orderBy(F.col("started").desc(), F.col("session_id").desc()).limit(limit)


def first_of(rows: DataFrame, by: str, order) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__n = 1").drop("__n")


def ingested(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """chunks, nodes and edges of one JSON object of lists, as a client would send them."""
    import json

    data = json.loads(text)
    kinds = {
        "chunks": "id string, content string, chunk_type string, file_path string, start_line int, end_line int, language string, embedding array<float>",
        "nodes": "id string, node_type string, name string, file_path string",
        "edges": "source_id string, target_id string, edge_type string",
    }
    out = {}
    for name, schema in kinds.items():
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        out[name] = spark.createDataFrame([tuple(row.get(c) for c in names) for row in data.get(name, [])], schema)
    return out


def exported_state(stats: DataFrame, manifest_rows: DataFrame, session_rows: DataFrame) -> DataFrame:
    """JSON lines (kind, value) of all that a project has."""
    rows = [(kind, df) for kind, df in (("stats", stats), ("manifest", manifest_rows), ("sessions", session_rows))]
    parts = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("value")) for kind, df in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
