"""One-hop graph operators over node and edge tables: neighbours, related files, cascading deletes, expansion.

nodes: id, node_type, name, file_path. edges: source_id, target_id, edge_type. Edges are directed and only those
whose target exists count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from .search import top


def neighbours(edges: DataFrame, nodes: DataFrame, sources: DataFrame, edge_type: str | None = None, direction: str = "out") -> DataFrame:
    """(source_id, id, node_type, name, file_path) of the nodes that the sources (source_id) point at."""
    if edge_type:
        edges = edges.where(F.col("edge_type") == edge_type)
    if direction == "in":
        edges = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type")
    met = edges.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    return met.join(nodes, met["target_id"] == nodes["id"]).select("source_id", "id", "node_type", "name", "file_path").distinct()


def file_neighbours(edges: DataFrame, nodes: DataFrame, files: DataFrame, edge_types=None, node_types=None) -> DataFrame:
    """Distinct target nodes of edges that start in the given files (file_path)."""
    own = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("source_id"), F.col("file_path").alias("from_file"))
    met = edges if edge_types is None else edges.where(F.col("edge_type").isin(*edge_types))
    targets = nodes if node_types is None else nodes.where(F.col("node_type").isin(*node_types))
    return met.join(own, "source_id").join(targets, F.col("target_id") == F.col("id")).select("from_file", "id", "node_type", "name", "file_path").distinct()


def related_files(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Files that calls and imports of the given files lead to, without these themselves."""
    found = file_neighbours(edges, nodes, files, ("calls", "imports"), ("function", "class", "file", "module"))
    return found.select("file_path").distinct().join(files.select("file_path").distinct(), "file_path", "left_anti")


def without_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the files went: edges that touch a gone node at either end go too."""
    gone = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("gone"))
    kept = nodes.join(files.select("file_path").distinct(), "file_path", "left_anti")
    left = edges.join(gone, edges["source_id"] == gone["gone"], "left_anti")
    return kept, left.join(gone, left["target_id"] == gone["gone"], "left_anti")


def nodes_where(nodes: DataFrame, file_path: str | None = None, node_type: str | None = None) -> DataFrame:
    """Nodes of a file, of a type, or both."""
    if file_path is not None:
        nodes = nodes.where(F.col("file_path") == file_path)
    return nodes if node_type is None else nodes.where(F.col("node_type") == node_type)


def related_to(ranked: DataFrame, edges: DataFrame, nodes: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """(query_id, file_path) of the files that calls and imports of each query's best ranked files lead to, the first by path."""
    heads = ranked.where(F.col("rank") < s.expansion_files).select("query_id", F.col("file_path").alias("from_file")).distinct()
    found = file_neighbours(edges, nodes, heads.select(F.col("from_file").alias("file_path")), ("calls", "imports"), ("function", "class", "file", "module"))
    related = heads.join(found.select("from_file", "file_path").distinct(), "from_file").select("query_id", "file_path").distinct()
    related = related.join(heads.select("query_id", F.col("from_file").alias("file_path")), ["query_id", "file_path"], "left_anti")
    return top(related, s.expansion_related, [F.col("file_path")], rank="file_no").drop("file_no")


def expand(ranked: DataFrame, edges: DataFrame, nodes: DataFrame, chunks: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Chunks of files related to the best ranked ones: (query_id, id, file_path, score), none that is ranked already.

    ranked: query_id, id, file_path, rank. chunks: query_id, id, file_path, distance.
    """
    return _nearest(ranked, chunks.join(related_to(ranked, edges, nodes, s), ["query_id", "file_path"]), s)


def expand_all(ranked: DataFrame, edges: DataFrame, nodes: DataFrame, vectors: DataFrame, queries: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """``expand`` with the distances of all chunks of the related files, and of no others: vectors (id, file_path, embedding), queries (query_id, query)."""
    from .search import l2, small, small_as

    own = vectors.where("embedding is not null").join(small_as(related_to(ranked, edges, nodes, s), queries), "file_path").join(small(queries), "query_id")
    return _nearest(ranked, own.select("query_id", "id", "file_path", l2(F.col("query"), F.col("embedding")).alias("distance")), s)


def _nearest(ranked: DataFrame, chunks: DataFrame, s: Settings) -> DataFrame:
    near = top(chunks, s.expansion_chunks, [F.col("distance"), F.col("id")], ["query_id", "file_path"], "chunk_no").drop("chunk_no")
    score = F.greatest(F.lit(0.0), 1 - F.col("distance")) * s.expansion_factor
    fresh = near.join(ranked.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return fresh.withColumn("score", score).where(F.col("score") >= s.default_confidence).select("query_id", "id", "file_path", "score")


def code_graph(chunks: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of chunks (id, chunk_type, file_path, content) and imports (file_path, module)."""
    from ..functions.text import node_name

    file_id = F.concat(F.lit("file_"), F.col("file_path"))
    name = F.element_at(F.split("file_path", "/"), -1)
    files = chunks.select("file_path").distinct().select(file_id.alias("id"), F.lit("file").alias("node_type"), name.alias("name"), "file_path")
    own = chunks.select("id", F.col("chunk_type").alias("node_type"), node_name(F.col("content"), F.col("id")).alias("name"), "file_path")
    defines = chunks.select(file_id.alias("source_id"), F.col("id").alias("target_id"), F.lit("defines").alias("edge_type"))
    wanted = imports.select(file_id.alias("source_id"), F.concat(F.lit("module_"), F.col("module")).alias("target_id"), F.lit("imports").alias("edge_type"))
    return files.unionByName(own), defines.unionByName(wanted).distinct()


def resolved_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Import edges that point at modules, led to the files of that stem."""
    stems = nodes.where("node_type = 'file'").select(F.concat(F.lit("module_"), F.regexp_replace("name", r"\.[^.]*$", "")).alias("module_id"), F.col("id").alias("file_id"))
    found = edges.where("edge_type = 'imports'").join(stems, F.col("target_id") == F.col("module_id")).select("source_id", F.col("file_id").alias("target_id"), "edge_type")
    return edges.where("edge_type <> 'imports'").unionByName(found)
