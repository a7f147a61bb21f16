"""The ledger of token savings: rollups, reports, per-file caps and accuracy measures.

ledger: bucket, baseline, served, meta (JSON), ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BUCKETS
from ..functions.tokens import cost, shown_cost, short_number

OUTPUT = ("output_compression",)


def known(ledger: DataFrame) -> DataFrame:
    """Rows of canonical buckets."""
    return ledger.where(F.col("bucket").isin(*BUCKETS))


def bucket_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")


def by_bucket(ledger: DataFrame) -> DataFrame:
    """(bucket, baseline, served, calls) of all canonical buckets, zeros where nothing was logged."""
    sums = known(ledger).groupBy("bucket").agg(F.sum("baseline").alias("baseline"), F.sum("served").alias("served"), F.count("*").alias("calls"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return F.broadcast(bucket_table(ledger.sparkSession)).join(sums, "bucket", "left").select("bucket", zero("baseline"), zero("served"), zero("calls"))


def levels(ledger: DataFrame, key: str = "level") -> DataFrame:
    """(level, calls) of one field of the meta JSON; null, invalid and missing ones are skipped."""
    own = F.get_json_object("meta", f"$.{key}")
    return ledger.select(own.alias("level")).where("level is not null").groupBy("level").agg(F.count("*").alias("calls"))


def report(ledger: DataFrame, input_rate: float, output_rate: float) -> DataFrame:
    """Per bucket: tokens saved, share of the whole baseline, cost at its rate; the most saved first (``place``)."""
    rows = by_bucket(ledger).withColumn("saved", F.col("baseline") - F.col("served"))
    total = F.sum("baseline").over(Window.partitionBy(F.lit(1)))  # seven rows
    rate = F.when(F.col("bucket").isin(*OUTPUT), output_rate).otherwise(input_rate)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("saved").desc(), F.col("bucket")))
    share = F.when(total > 0, F.round(100 * F.col("saved") / F.when(total > 0, total), 6)).otherwise(0.0)
    return rows.select("bucket", "baseline", "served", "calls", "saved", share.alias("pct"), F.round(cost(F.col("saved"), rate), 6).alias("cost"), place.alias("place"))


def line(ledger: DataFrame, rate: float) -> DataFrame:
    """One line: baseline of retrieval against what compression served, or retrieval if it was never called."""
    pick = lambda bucket, c: F.max(F.when(F.col("bucket") == bucket, F.col(c)))
    own = by_bucket(ledger).agg(pick("retrieval", "baseline").alias("baseline"), pick("retrieval", "served").alias("plain"), pick("chunk_compression", "served").alias("small"), pick("chunk_compression", "calls").alias("calls"))
    own = own.withColumn("served", F.when(F.col("calls") > 0, F.col("small")).otherwise(F.col("plain")))
    saved = F.greatest(F.col("baseline") - F.col("served"), F.lit(0))
    pct = F.when(F.col("baseline") > 0, F.floor(100 * saved / F.greatest(F.col("baseline"), F.lit(1)))).otherwise(0)
    text = F.concat_ws(" ", short_number(saved), F.lit("tokens saved"), F.format_string("(%d%%)", pct.cast("bigint")), F.nullif(shown_cost(cost(saved, F.lit(rate))), F.lit("")))
    return own.select("baseline", "served", saved.alias("saved"), pct.cast("bigint").alias("pct"), text.alias("line"))


def file_caps(rows: DataFrame, overflow_cost: int = 30) -> DataFrame:
    """(query_id, baseline, served) of results (query_id, file_path, tokens, file_tokens, inline).

    A file counts no more than its own tokens; results that only got a reference cost a fixed number.
    """
    served = F.sum(F.when(F.col("inline"), F.col("tokens")).otherwise(overflow_cost))
    files = rows.groupBy("query_id", "file_path").agg(F.sum("tokens").alias("raw"), served.alias("served"), F.max("file_tokens").alias("file_tokens"))
    return files.groupBy("query_id").agg(F.sum(F.least("raw", "file_tokens")).alias("raw"), F.sum(F.least("served", "file_tokens")).alias("served"), F.sum("file_tokens").alias("baseline"))


def precision_recall(results: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query (query_id): precision 0 without results, recall 1 without expectations; rows are distinct (query_id, file)."""
    got = results.select("query_id", "file").distinct()
    want = expected.select("query_id", "file").distinct()
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    own = queries.select("query_id").join(count(got, "got"), "query_id", "left").join(count(want, "want"), "query_id", "left").join(count(got.join(want, ["query_id", "file"]), "hit"), "query_id", "left").na.fill(0)
    precision = F.when(F.col("got") > 0, F.col("hit") / F.greatest("got", F.lit(1))).otherwise(0.0)
    recall = F.when(F.col("want") > 0, F.col("hit") / F.greatest("want", F.lit(1))).otherwise(1.0)
    return own.select("query_id", "got", "want", "hit", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"))


def recall_at_k(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per query: recall@k, precision@k and reciprocal rank; all 1 if nothing is relevant and nothing returned."""
    mark = relevant.select("query_id", "id").distinct().withColumn("good", F.lit(True))
    marked = ranked.join(mark, ["query_id", "id"], "left").select("query_id", "rank", "good")
    return recall_of_marked(marked, mark.groupBy("query_id").agg(F.count("*").alias("want")), queries, k)


def recall_of_marked(marked: DataFrame, want: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``recall_at_k`` of results that are marked already (query_id, rank, good), and how many are relevant to a query (query_id, want)."""
    good = F.coalesce("good", F.lit(False))
    hits = marked.where(F.col("rank") < k).groupBy("query_id").agg(F.count("*").alias("shown"), F.sum(good.cast("int")).alias("hit"), F.min(F.when(good, F.col("rank") + 1)).alias("first"))
    own = queries.select("query_id").join(hits, "query_id", "left").join(want, "query_id", "left").na.fill(0, ["shown", "hit", "want"])
    off = (F.col("want") == 0) & (F.col("shown") == 0)
    ratio = lambda a, b: F.when(off, 1.0).when(F.col(b) > 0, F.col(a) / F.greatest(b, F.lit(1))).otherwise(0.0)
    first = F.when(off, 1.0).when(F.col("first").isNotNull(), 1 / F.col("first")).otherwise(0.0)
    return own.select("query_id", F.round(ratio("hit", "want"), 6).alias("recall"), F.round(ratio("hit", "shown"), 6).alias("precision"), F.round(first, 6).alias("mrr"))


def picked_percentiles(rows: DataFrame, value: str, by: str, parts=((50, 2, 1), (95, 100, 95), (99, 100, 99))) -> DataFrame:
    """(by, p50, p95, p99): the values at places n // 2, int(.95 n), int(.99 n) of the sorted list."""
    # Equal values are one row with their count before anything is sorted.
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    sized = counted.withColumn("upto", upto).join(counted.groupBy(by).agg(F.sum("c").alias("n")), by)
    place = lambda c, b: F.floor(F.col("n") * c / b).cast("int")
    return sized.groupBy(by).agg(*(F.min(F.when(F.col("upto") > place(c, b), F.col("v"))).alias(f"p{p}") for p, b, c in parts))


def savings_ratio(rows: DataFrame, baseline: str, served: str) -> Column:
    """1 - served / baseline over all rows, 0 without a baseline."""
    return F.when(F.sum(baseline) > 0, 1 - F.sum(served) / F.sum(baseline)).otherwise(0.0)
