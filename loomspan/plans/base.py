"""Tables as the engine's own relations, and the registry of queries with the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = 1_704_067_200

#: The same relations in DuckDB, to put before a query.
CTE = {
    "files": "files AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS file_path, text AS content, lang AS language, source FROM documents)",
    "terms": r"terms AS (SELECT doc_id AS id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents)",
    "asked": r"asked AS (SELECT item_id AS query_id, text, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM benchmark WHERE item_id % 50 = 0)",
    "turns": "turns AS (SELECT conv_id AS session_id, turn AS \"at\", role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt_number FROM conversations)",
    "ledger": "ledger AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'retrieval' WHEN 'view' THEN 'chunk_compression' WHEN 'purchase' THEN 'memory_recall' WHEN 'signup' THEN 'grammar' WHEN 'error' THEN 'unknown' END AS bucket, CAST(floor(value * 10) AS BIGINT) AS baseline, CAST(floor(value * 3) AS BIGINT) AS served, props AS meta, ts FROM events)",
    "edges": "edges AS (SELECT DISTINCT 'o' || l_orderkey AS source_id, 'p' || l_partkey AS target_id, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'defines' END AS edge_type FROM lineitem)",
    "nodes": "nodes AS (SELECT 'o' || o_orderkey AS id, 'file' AS node_type, o_orderpriority AS name, 'orders/' || o_custkey || '.py' AS file_path FROM orders UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_size < 25 THEN 'function' ELSE 'class' END, p_name, 'parts/' || p_brand || '.py' FROM part)",
}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Registers a function of (spark, sf_dir) and its SQL after the named relations."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = ("WITH RECURSIVE " + ", ".join(CTE[c] for c in ctes) + " " if ctes else "") + sql.strip()
        return f

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"), "source")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: items whose id is divisible by 50."""
    return t(spark, sf, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 50."""
    return t(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.memory import numbered_prompts

    return numbered_prompts(t(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), "role", "text"))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    bucket = F.when(kind == "click", "retrieval").when(kind == "view", "chunk_compression").when(kind == "purchase", "memory_recall").when(kind == "signup", "grammar").when(kind == "error", "unknown")
    return t(spark, sf, "events").select("event_id", bucket.alias("bucket"), F.floor(F.col("value") * 10).alias("baseline"), F.floor(F.col("value") * 3).alias("served"), F.col("props").alias("meta"), "ts")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return t(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.when(flag == "A", "calls").when(flag == "N", "imports").otherwise("defines").alias("edge_type")).distinct()


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    a = t(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("file").alias("node_type"), F.col("o_orderpriority").alias("name"), F.concat(F.lit("orders/"), "o_custkey", F.lit(".py")).alias("file_path"))
    b = t(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(F.col("p_size") < 25, "function").otherwise("class").alias("node_type"), F.col("p_name").alias("name"), F.concat(F.lit("parts/"), "p_brand", F.lit(".py")).alias("file_path"))
    return a.unionByName(b)


def epoch(ts):
    return F.unix_seconds(F.col(ts).cast("timestamp"))
