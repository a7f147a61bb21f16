"""Functions under their SQL names equal the column functions."""

from pyspark.sql import functions as F

from loomspan.functions import decisions, grammar, sql, text

TEXTS = [
    "The configuration of the database is really very simple. We decided to use Parquet because it is columnar and fast.",
    "def load(path, limit=3):\n    self.reader = Reader(path)\n    total = limit\n    return total",
    "x " * 900,
    "",
    None,
]


def test_sql_functions_equal_columns(spark):
    names = sql.register(spark)
    assert len(names) == len(set(names))
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(TEXTS)], "id int, content string")
    rows.createOrReplaceTempView("sql_function_rows")
    got = spark.sql(
        "SELECT id, grammar_compress(content, 'full') AS small, grammar_expand(content) AS whole, decisions_in(content) AS found, "
        "compression_ratio(content, substr(content, 1, 10)) AS ratio, fallback_text(content, 'minimal') AS cut, fallback_text(content, 'other') AS other, "
        "code_identifiers(content) AS names, keeps_identifiers(content, 'the reader of total') AS kept FROM sql_function_rows"
    )
    c = F.col("content")
    want = rows.select(
        "id", grammar.compressed(c, "full").alias("small"), grammar.expanded(c).alias("whole"), decisions.extracted(c).alias("found"),
        grammar.ratio(c, F.substring(c, 1, 10)).alias("ratio"), text.fallback(c, F.lit("minimal")).alias("cut"), text.fallback(c, F.lit("other")).alias("other"),
        text.identifiers(c).alias("names"), text.keeps_identifiers(c, F.lit("the reader of total")).alias("kept"),
    )
    assert got.orderBy("id").collect() == want.orderBy("id").collect()


def test_sql_functions_can_be_registered_again(spark):
    assert sql.register(spark) == sql.register(spark)
    assert spark.sql("SELECT compression_ratio('', 'x') AS r").first().r == 0.0
