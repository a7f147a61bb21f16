"""One object over a store of tables: index, search, related context, recall and the ledger, for tables of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import LEVEL_SHARE, SETTINGS, Settings
from .functions import text as tx
from .functions.tokens import counted_tokens
from .operators import compress, graph, indexing, memory, present, retention, search
from .operators.snapshots import Store
from .sources import embed


#: Tables of a project's memory, kept by months beside the index.
MEMORY = {
    "turns": "session_id string, prompt_number long, summary string, created long",
    "events": "id long, session_id string, prompt_number long, tool_name string, raw_input string, raw_output string, created long",
    "decisions": "id long, session_id string, decision string, reason string, source string, created long",
    "areas": "id long, session_id string, file_path string, description string, source string, created long",
}


class ContextEngine:
    """``store`` is a folder that ``index`` fills; queries are tables, so that many run in one job.

    What sessions leave (``remember``, ``record_decisions``, ``record_areas``) is kept in a store of its own beside the index.
    """

    def __init__(self, spark: SparkSession, store: str, settings: Settings = SETTINGS, embedder=embed.hashed_vectors):
        self.spark, self.store, self.settings, self.embedder = spark, store, settings, embedder

    def index(self, root: str, **options) -> indexing.Indexed:
        return indexing.index(self.spark, root, self.store, embedder=self.embedder, **options)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return indexing.read(self.spark, self.store, name, version)

    def ranked(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """Fused, scored, capped and expanded chunks of queries (query_id, text): (query_id, id, file_path, score, rank)."""
        s, k = self.settings, max(1, min(100, top_k or self.settings.top_k))
        db = Store(self.spark, self.store)
        now = db.snapshot()  # one version for all tables, whatever is published meanwhile
        chunks = db.read(now, "chunks", indexing.SCHEMAS["chunks"]).dropDuplicates(["id"])
        asked = embed.embedded(queries, "text", self.embedder).select("query_id", F.col("embedding").alias("query")).where("query is not null")
        near = search.knn(asked, chunks.select("id", "embedding", "file_path", "start_line", "end_line"), 3 * k)
        near = search.dedup_first(near, ["file_path", "start_line", "end_line"], [F.col("rank")])
        kept = indexing.full_text(self.spark, now)
        found = kept.phrase_search(queries, 3 * k) if kept.folders else search.phrase_search(queries, chunks.select("id", "content"), 3 * k)
        parsed = queries.select("query_id", tx.intent(F.col("text")).alias("intent"), tx.keywords(F.col("text")).alias("words"), tx.file_hints(F.col("text")).alias("hints"))
        fused = search.rrf(near, found, search.intent_weights(parsed, s), s).join(search.small_as(parsed, queries), "query_id")
        rows = fused.join(chunks.select("id", "content", "file_path"), "id")
        rows = rows.withColumn("keyword_distance", tx.keyword_distance(F.col("words"), F.col("hints"), F.col("file_path"), F.col("content"))).withColumn("modified", F.lit(None).cast("double"))
        capped = search.capped(search.hybrid_score(rows, s), k, s.max_per_file).select("query_id", "id", "file_path", "score", "rank")
        more = graph.expand_all(capped, db.read(now, "edges", indexing.SCHEMAS["edges"]), db.read(now, "nodes", indexing.SCHEMAS["nodes"]), chunks.select("id", "file_path", "embedding"), asked, s)
        last = search.top(more, 1 << 20, [F.col("score").desc(), F.col("id")]).withColumn("rank", F.col("rank") + k)
        return capped.unionByName(last.select(*capped.columns))

    def search(self, queries: DataFrame, top_k: int | None = None, max_tokens: int | None = None, level: str = "standard") -> DataFrame:
        """(query_id, text): what fits the token budget, and references to the rest."""
        budget = max_tokens or self.settings.max_tokens
        chunks = self.table("chunks").dropDuplicates(["id"])
        rows = self.ranked(queries, 2 * (top_k or self.settings.top_k)).where(~present.is_tool_file(F.col("file_path")))
        full = rows.withColumnRenamed("score", "confidence_score").join(chunks.drop("file_path"), "id")
        small = compress.compressed(full, level)
        place = search.top(small, 1 << 20, [F.col("rank"), F.col("id")], rank="place").withColumn("number", F.xxhash64("id"))
        fold = search.packed(place.select("query_id", F.col("place").alias("rank"), F.col("number").alias("id"), counted_tokens(F.col("compressed_content")).alias("tokens"), F.lit(None).cast("bigint").alias("small_tokens")), budget)
        inline = place.join(fold.select("query_id", F.col("rank").alias("place"), F.col("taken").alias("inline")), ["query_id", "place"])
        return present.results(inline.select("query_id", F.col("place").alias("rank"), "id", "file_path", "start_line", F.col("confidence_score").alias("score"), F.col("compressed_content").alias("served"), "inline"))

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.table("chunks").where(F.col("id") == chunk_id)

    def related(self, chunk_id: str, edge_type: str | None = None, direction: str = "out") -> DataFrame:
        """Nodes that a chunk's edges lead to (or come from)."""
        one = self.spark.createDataFrame([(chunk_id,)], "source_id string")
        return graph.neighbours(self.table("edges"), self.table("nodes"), one, edge_type, direction)

    def index_status(self) -> DataFrame:
        """One row: the index's version, files, chunks, buckets, full-text generations and dimension; zeros before the first run."""
        db = Store(self.spark, self.store)
        now = db.snapshot()
        counts = [db.read(now, t, indexing.SCHEMAS[t]).agg(F.count("*").alias(n)) for t, n in (("manifest", "files"), ("chunks", "chunks"))]
        facts = [F.lit(now.version).alias("version"), "files", "chunks", F.lit(now.facts.get("buckets", 0)).alias("buckets"), F.lit(len(now.folders("fts"))).alias("generations"), F.lit(now.facts.get("dimension", 0)).alias("dimension")]
        return counts[0].join(F.broadcast(counts[1])).select(*facts)  # one row each

    @property
    def memory(self) -> Store:
        return Store(self.spark, f"{self.store.rstrip('/')}/memory")

    def remembered(self, table: str, archived: bool = False) -> DataFrame:
        """A table of ``MEMORY``, or what retention has moved to its archive."""
        return self.memory.read(self.memory.snapshot(), retention.archive_of(table) if archived else table, MEMORY[table])

    def remember(self, table: str, rows: DataFrame) -> None:
        """Appends rows; columns that they lack are null, ``created`` is now."""
        own = rows if "created" in rows.columns else rows.withColumn("created", F.lit(self.settings.as_of).cast("bigint"))
        kinds = [x.split() for x in MEMORY[table].split(", ")]
        retention.add(self.memory, table, own.select(*((F.col(n) if n in own.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds)))

    def _recorded(self, table: str, rows: DataFrame, words: list[str]) -> None:
        bare = [F.col(w).isNull() | (F.trim(w) == "") for w in words]
        if rows.where(reduce(lambda a, b: a | b, bare)).limit(1).count():
            raise ValueError(f"{' and '.join(words)} are needed")
        own = rows if "source" in rows.columns else rows.withColumn("source", F.lit("manual"))
        self.remember(table, own.withColumn("id", F.xxhash64(*words, F.lit(self.settings.as_of))))

    def record_decisions(self, rows: DataFrame) -> None:
        """Decisions (decision, reason, maybe session_id, source) for later recall."""
        self._recorded("decisions", rows, ["decision", "reason"])

    def record_areas(self, rows: DataFrame) -> None:
        """Code areas (file_path, description, maybe session_id, source) for later recall."""
        self._recorded("areas", rows, ["file_path", "description"])

    def timeline(self, session_id: str, limit: int = 20) -> DataFrame:
        """(prompt_number, summary, events): the first turns of a session, with the ids of their events."""
        own = lambda t: self.remembered(t).where(F.col("session_id") == session_id)
        events = own("events").groupBy("prompt_number").agg(F.sort_array(F.collect_list("id")).alias("events"))
        turns = own("turns").orderBy("prompt_number", "created").limit(max(1, limit))
        return turns.join(events, "prompt_number", "left").select("prompt_number", "summary", "events").orderBy("prompt_number")

    def event(self, event_id: int) -> DataFrame:
        return self.remembered("events").where(F.col("id") == event_id)

    def items(self) -> DataFrame:
        """(id, text) of all decisions, turns and areas, as ``recall`` takes them."""
        session = F.when(F.col("session_id").isNotNull(), F.concat(F.lit(" · → session_timeline("), "session_id", F.lit(")"))).otherwise("")
        hint = F.concat(F.lit(" · "), tx.relative_time(F.col("created"), self.settings.as_of), session)
        told = {
            "decisions": F.concat(F.lit("[decision] "), "decision", F.lit(" because "), "reason", hint),
            "turns": F.concat(F.lit("[turn] "), "summary", hint),
            "areas": F.concat(F.lit("[area] "), "file_path", F.lit(": "), "description", hint),
        }
        parts = [self.remembered(t).select(text.alias("text")).where("text is not null") for t, text in told.items()]
        return reduce(DataFrame.unionByName, parts).select(F.xxhash64("text").alias("id"), "text")

    def recall_all(self, topics: DataFrame) -> DataFrame:
        """``recall`` over all that is remembered."""
        return self.recall(topics, self.items())

    def prune(self) -> dict[str, int]:
        """Moves memory rows that are older than the settings' days to the archives."""
        s = self.settings
        return retention.prune(self.memory, MEMORY, s.as_of, {"turns": s.turn_days, "decisions": s.decision_days, "areas": s.area_days})

    def set_level(self, level: str) -> None:
        """How short replies are to be: off, lite, standard or max; kept with the memory."""
        if level not in LEVEL_SHARE:
            raise ValueError(f"the level has to be one of {', '.join(LEVEL_SHARE)}")
        self.memory.publish(self.memory.snapshot(), facts={"level": level})

    def level(self) -> str:
        return self.memory.snapshot().facts.get("level", "standard")

    def recall(self, topics: DataFrame, items: DataFrame) -> DataFrame:
        """(query_id, text) of what earlier sessions say on topics (query_id, topic); items: (id, text)."""
        s = self.settings
        keyed = items.withColumn("key", memory.content_key(F.col("text")))
        asked = topics.select("query_id", F.array_join(tx.topic_words(F.col("topic")), " ").alias("text"))
        lexical = search.or_search(asked, keyed.select("id", F.col("key").alias("content")), s.recall_fts_limit)
        vectors = embed.embedded(keyed, "key", self.embedder).select("id", "embedding")
        q = embed.embedded(topics, "topic", self.embedder).select("query_id", F.col("embedding").alias("query")).where("query is not null")
        near = search.knn(q, vectors, s.recall_vector_limit).where(F.col("distance") <= s.max_l2)
        lists = lexical.select("query_id", F.lit(0).alias("list"), "rank", "id").unionByName(near.select("query_id", F.lit(1).alias("list"), "rank", "id"))
        fused = search.rank_lists(lists.join(keyed, "id").select("query_id", "list", "rank", "key", "text"), s.recall_top, s)
        plain = present.substring_fallback(fused, keyed, topics).withColumn("rank", F.row_number().over(search.Window.partitionBy("query_id").orderBy("key")) - 1)
        hits = fused.join(topics, "query_id").select("query_id", "topic", "rank", "key", "text").unionByName(plain.select("query_id", "topic", "rank", "key", "text"))
        return present.recall_text(hits)
