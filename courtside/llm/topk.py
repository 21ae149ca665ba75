"""Exact top-k search by inner product, with a KD-tree per shard.

Vectors are dealt to shards by hash. Each shard is one row: a KD-tree with median splits and tight bounding boxes. A
block of queries walks a tree best box first: the box's largest possible inner product is its bound, and the walk ends
when no box left can beat the query's k-th score. Every query first walks one shard; the k-th score it finds there goes
with it to all other shards, where it cuts most of the work at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import stored, table

SHARD_ROWS = 4096
LEAF_ROWS = 128
BLOCK_ROWS = 512
SCALE = 64


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """v_id, v (floor(scale * x) as doubles), v_dim; without null vectors and those with null or non-finite components."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("v_id"), F.when(finite, F.transform(x, lambda c: F.floor(c * scale).cast("double"))).alias("v"))
    return rows.filter(F.col("v").isNotNull()).withColumn("v_dim", F.size("v"))


def build(points: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A KD-tree in arrays: rows in leaf order; per node its range of rows, its children (-1: leaf) and its tight box."""
    order = np.arange(len(points))
    spans, children, low, high = [], [], [], []

    def node(first: int, last: int) -> int:
        own = points[order[first:last]]
        at = len(spans)
        spans.append((first, last))
        children.append((-1, -1))
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        spread = high[at] - low[at]
        if last - first > leaf_rows and spread.size and spread.max() > 0:
            middle = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(own[:, spread.argmax()], middle)]
            children[at] = (node(first, first + middle), node(first + middle, last))
        return at

    node(0, len(points))
    return {"points": points[order], "ids": ids[order], "spans": np.array(spans), "children": np.array(children), "low": np.array(low), "high": np.array(high)}


def search(tree: dict[str, np.ndarray], queries: np.ndarray, ids: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query id, vector id, score) of each query's k best in the tree, best first; none that is below the query's floor.

    The bound of a box is the sum over its sides of the larger product. A box that just ties is still opened, since its
    ids may be smaller.
    """
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = up @ tree["high"].T + down @ tree["low"].T
    children, spans = tree["children"].tolist(), tree["spans"].tolist()
    for q, own, bound, floor in zip(queries, ids.tolist(), bounds, floors.tolist(), strict=True):
        best_scores, best_ids = np.empty(0), np.empty(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= floor:
            _, at = heapq.heappop(heap)
            left, right = children[at]
            if left >= 0:
                heapq.heappush(heap, (-bound[left], left))
                heapq.heappush(heap, (-bound[right], right))
                continue
            first, last = spans[at]
            scores, found = tree["points"][first:last] @ q, tree["ids"][first:last]
            fit = (scores >= floor) & (found != own)
            scores, found = np.concatenate((best_scores, scores[fit])), np.concatenate((best_ids, found[fit]))
            top = np.lexsort((found, -scores))[:k]
            best_scores, best_ids = scores[top], found[top]
            if len(top) == k:
                floor = max(floor, best_scores[-1])
        yield from ((own, int(i), float(s)) for i, s in zip(best_ids, best_scores, strict=True))


def _trees(rows: pd.DataFrame) -> pd.DataFrame:
    tree = build(np.vstack(rows["v"].to_numpy()).reshape(len(rows), -1), rows["v_id"].to_numpy(np.int64))
    first = rows.iloc[0]
    shape = {name: [np.ascontiguousarray(part).tobytes()] for name, part in tree.items()}
    return pd.DataFrame({"v_dim": [first["v_dim"]], "v_shard": [first["v_shard"]], "nodes": [len(tree["spans"])], **shape})


def _walk(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                dim, nodes = row["v_dim"], row["nodes"]
                tree = {name: np.frombuffer(row[name], np.float64).reshape(-1, dim) if dim else np.zeros((len(row["ids"]) // 8 if name == "points" else nodes, 0)) for name in ("points", "low", "high")}
                tree |= {"ids": np.frombuffer(row["ids"], np.int64), "spans": np.frombuffer(row["spans"], np.int64).reshape(-1, 2), "children": np.frombuffer(row["children"], np.int64).reshape(-1, 2)}
                queries = row["block"]
                ids = np.array([q["v_id"] for q in queries], np.int64)
                floors = np.array([-np.inf if q["v_floor"] is None else q["v_floor"] for q in queries])
                found = list(search(tree, np.array([q["v"] for q in queries], np.float64).reshape(len(queries), dim), ids, floors, k))
                columns = list(zip(*found, strict=True)) if found else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _meet(trees: DataFrame, queries: DataFrame, k: int, block_rows: int) -> DataFrame:
    """queries (v_id, v, v_dim, v_shard, v_floor) go to their shard in blocks of bounded size."""
    block = F.floor((F.row_number().over(Window.partitionBy("v_dim", "v_shard", F.pmod("v_id", F.lit(16))).orderBy("v_id")) - 1) / block_rows)
    blocks = queries.withColumn("v_block", block).groupBy("v_dim", "v_shard", F.pmod("v_id", F.lit(16)).alias("v_slice"), "v_block").agg(F.collect_list(F.struct("v_id", "v", "v_floor")).alias("block"))
    met = trees.join(blocks, ["v_dim", "v_shard"]).select(*trees.columns, "block")
    return met.mapInArrow(_walk(k), "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))


def top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each row that is a query: its k best other rows by inner product. query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x), so scores are whole numbers. Ties go to the smaller id. Null vectors and those
    with null or non-finite components take no part; a vector meets only those of its own length. With fewer than k
    others, a query has all of them. Rows without an id take no part; rows that repeat an id count once, with the vector that
    is the least in order. An empty table
    gives an empty result. Other columns of the input are not read.
    """
    points = stored(usable(vectors.filter(F.col(id_col).isNotNull()), id_col, vector_col, scale).groupBy("v_id").agg(F.min("v").alias("v"), F.min_by("v_dim", "v").alias("v_dim")))
    counts = points.groupBy("v_dim").agg(F.ceil(F.count("*") / shard_rows).alias("v_shards"))  # one row per vector length
    placed = points.join(F.broadcast(counts), "v_dim").withColumn("v_shard", F.pmod(F.xxhash64("v_id"), F.col("v_shards")))
    kinds = "v_dim int, v_shard long, nodes int, points binary, ids binary, spans binary, children binary, low binary, high binary"
    trees = stored(placed.groupBy("v_dim", "v_shard").applyInPandas(_trees, kinds))

    queries = placed.filter(is_query).select("v_id", "v", "v_dim", "v_shard", "v_shards")
    home = stored(_meet(trees, queries.drop("v_shards").withColumn("v_floor", F.lit(None).cast("double")), k, block_rows))
    floors = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("v_floor"))
    away = queries.join(floors, F.col("v_id") == F.col("query_id"), "left").withColumn("v_home", F.col("v_shard"))
    away = away.withColumn("v_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_shards") - 1))).filter("v_shard <> v_home")
    found = home.unionByName(_meet(trees, away.select("v_id", "v", "v_dim", "v_shard", "v_floor"), k, block_rows))
    ranked = found.withColumn("rank", _best(found, k)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("v_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score::BIGINT AS score FROM r WHERE rank <= 20"""
