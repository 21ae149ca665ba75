"""Ranked lexical search, a term at a time with limited accumulators.

Documents become postings of the terms that items ask for, and stay where they are: a task takes them in shards of bounded
size, inverts each and runs all items of a block over it. An item's terms come rarest first. A term's postings make an
accumulator for every document that has none, until what the remaining terms can add at most is below the k-th partial
score: no document that begins then can reach the best k. From there on the accumulators that exist are only updated, and
end with exact scores.

A sixty-fourth of the documents is searched first. The k-th scores found there go with the items to all others, so that
shards stop early and hand on little more than what belongs to the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import forget, stored, table, text_of

#: Terms of all items of a block, repeats over items counted. A block's items are sent to every task; more items make more blocks.
BLOCK_TERMS = 500_000
#: A shard ends at so many documents or postings.
SHARD_DOCUMENTS, SHARD_POSTINGS = 16_384, 4_000_000
#: One document in so many is searched first.
FIRST = 64
#: Scale of a term's weight, and of what its occurrences add.
WEIGHT, GAIN, COUNT, SLOPE, BASE, LENGTH = 1000, 1_000_000_000, 1000, 20, 50, 50

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """All terms of a text in order, as UTF-8: no byte of a longer character is an ASCII one."""
    return text.encode("utf-8").translate(_PLAIN).split()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q_key, q_item, q_text) to a row for each distinct term: (q_key, q_item, q_term)."""
    for batch in batches:
        own = [sorted(set(terms_of(text))) for text in batch.column("q_text").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
        yield pa.RecordBatch.from_arrays([batch.column("q_key").take(at), batch.column("q_item").take(at), pa.array([t for x in own for t in x], pa.binary())], ["q_key", "q_item", "q_term"])


def _postings(words):
    """(p_id, p_text) to (p_id, p_first, p_n, p_terms, p_tfs) of texts with a term; terms are places in ``words``, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = {word: i for i, word in enumerate(words.value, 1)}.get, 0
        for batch in batches:
            keep, sizes, ids, counts = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, text in enumerate(batch.column("p_text").to_pylist()):
                own = terms_of(text)
                if own:
                    keep.append(i)
                    sizes.append(len(own))
                    found, often = np.unique(np.fromiter(filter(None, map(number, own)), np.int64), return_counts=True)
                    ids.append(found)
                    counts.append(often)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids[1:]], dtype=np.int64))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (ids, counts)]
            first = pa.array((np.arange(seen, seen + len(keep)) % FIRST) == 0)
            seen += len(keep)
            yield pa.RecordBatch.from_arrays([batch.column("p_id").take(pa.array(keep, pa.int64())), first, pa.array(sizes, pa.int64()), *lists], ["p_id", "p_first", "p_n", "p_terms", "p_tfs"])

    return run


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all that may be among the k best, scores exact. ``lists``: (documents, gains), rarest term first.

    ``floor`` is a score that k documents elsewhere reach; those that only tie with it stay.
    """
    rest = np.cumsum([gains.max() for _, gains in reversed(lists)])[::-1].tolist() + [0]
    scores, kept = np.zeros(documents, np.int64), None
    for at, (found, gains) in enumerate(lists):
        if kept is None:
            reached = floor
            if reached <= rest[at] < rest[0] - rest[at] and documents >= k:  # else the k-th can't be above the rest
                reached = np.partition(scores, documents - k)[documents - k]
            if rest[at] < reached:
                kept = np.flatnonzero(scores)
        if kept is None:
            scores[found] += gains
            continue
        place = np.searchsorted(found, kept)
        place[place == len(found)] = 0
        same = found[place] == kept
        scores[kept[same]] += gains[place[same]]
    kept = np.flatnonzero(scores) if kept is None else kept
    return kept, scores[kept]


def _shard(batches: list[pa.RecordBatch], items, weights: np.ndarray, count: int, total: int, k: int, floors: dict[int, int]) -> pa.RecordBatch:
    """The best k of each item in one shard, (q_key, p_id, score); raises the floors to the k-th scores found."""
    ids = pa.chunked_array([b.column("p_id") for b in batches]).combine_chunks()
    sizes = np.concatenate([b.column("p_n").to_numpy(zero_copy_only=False) for b in batches])
    terms, tfs = (np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in batches]) for c in ("p_terms", "p_tfs"))
    held = np.concatenate([pc.list_value_length(b.column("p_terms")).to_numpy(zero_copy_only=False) for b in batches])
    lengths = np.array([100 - LENGTH + BASE * n * count // total for n in sizes.tolist()], np.int64)
    docs = np.repeat(np.arange(len(sizes)), held)
    gains = weights[terms] * (GAIN * tfs // (COUNT * tfs + SLOPE * lengths[docs]))
    order = np.argsort(terms, kind="stable")
    terms, docs, gains = terms[order], docs[order], gains[order]
    present, starts = np.unique(terms, return_index=True)
    ends = np.append(starts[1:], len(terms))
    slot = np.full(len(weights), -1)
    slot[present] = np.arange(len(present))
    by_id = np.empty(len(ids), np.int64)
    by_id[pc.sort_indices(ids, null_placement="at_end").to_numpy(zero_copy_only=False)] = np.arange(len(ids))

    keys, rows, scores = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for key, asked in items:
        here = slot[asked]
        lists = [(docs[starts[s] : ends[s]], gains[starts[s] : ends[s]]) for s in here[here >= 0].tolist()]
        if not lists:
            continue
        floor = floors.get(key, 1)
        found, score = accumulate(lists, len(ids), k, floor)
        found, score = found[score >= floor], score[score >= floor]
        if len(score) > k:  # ties with the k-th stay for the order by id
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[near], score[near]
        best = np.lexsort((by_id[found], -score))[:k]
        if len(best) == k:
            floors[key] = max(floor, int(score[best[-1]]))
        keys.append(np.full(len(best), key, np.int64))
        rows.append(found[best])
        scores.append(score[best])
    all_keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(all_keys), ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores), pa.int64())], ["q_key", "p_id", "score"])


def _ranked(asked, count: int, total: int, k: int):
    """Postings to the best k of each item in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, known = asked.value
        floors, waiting, documents, postings = dict(known), [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_DOCUMENTS):
                part = batch.slice(at, SHARD_DOCUMENTS)
                waiting.append(part)
                documents, postings = documents + part.num_rows, postings + len(part.column("p_terms").flatten())
                if documents >= SHARD_DOCUMENTS or postings >= SHARD_POSTINGS:
                    yield _shard(waiting, items, weights, count, total, k, floors)
                    waiting, documents, postings = [], 0, 0
        if documents:
            yield _shard(waiting, items, weights, count, total, k, floors)

    return run


def _block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    """q_key, rank, p_id, score of one block of items, stored; None if no document has a term."""
    sc, kind = docs.sparkSession.sparkContext, docs.schema["p_id"].dataType.simpleString()
    words = sorted(bytes(r["q_term"]) for r in asked.select("q_term").distinct().collect())
    sent = sc.broadcast(words)
    postings = stored(docs.mapInArrow(_postings(sent), f"p_id {kind}, p_first boolean, p_n long, p_terms array<long>, p_tfs array<long>"))
    count, total = postings.agg(F.count("*"), F.sum("p_n")).first()
    if not count:
        forget(postings)
        return None
    often = dict(map(tuple, postings.select(F.explode("p_terms").alias("t")).groupBy("t").count().collect()))
    weights = np.zeros(len(words) + 1, np.int64)
    for term, df in often.items():
        weights[term] = math.floor(WEIGHT * math.log((2 * count + 2) / (2 * df + 1)))
    number, own = {word: i for i, word in enumerate(words, 1)}, {}
    for r in asked.select("q_key", "q_term").collect():
        term = number[bytes(r["q_term"])]
        if term in often:
            own.setdefault(r["q_key"], []).append((often[term], term))
    items = [(key, np.array([term for _, term in sorted(pairs)])) for key, pairs in sorted(own.items())]

    ranked = F.row_number().over(Window.partitionBy("q_key").orderBy(F.desc("score"), F.col("p_id").asc_nulls_last()))
    search = lambda rows, floors: rows.mapInArrow(_ranked(sc.broadcast((items, weights, floors)), count, total, k), f"q_key long, p_id {kind}, score long")
    first = stored(search(postings.filter("p_first"), {}))
    kth = first.withColumn("rank", ranked).filter(F.col("rank") == k).select("q_key", "score")
    others = search(postings.filter("not p_first"), dict(map(tuple, kth.collect())))
    out = stored(first.unionByName(others).withColumn("rank", ranked).filter(F.col("rank") <= k))
    forget(postings, first)
    return out


def lexical_search(
    docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """For each row of ``items``: its k best documents with a score above 0. item, rank (from 1), id, score.

    With N documents that have a term, L terms in all of them, n in one and df documents with a term, an item's terms add
    w * (10^9 tf div (1000 tf + 20 m)) once each, w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L. Ties go
    to the smaller id, null last. Each row of ``docs`` is a document and each row of ``items`` an item of its own, whatever
    ids repeat. Null texts have no terms; such documents count nowhere and such items have no rows. An empty table on either
    side gives an empty result. Other columns are not read. Items are taken in blocks of about ``block_terms`` terms, each a
    pass over all documents; a block's terms, their document counts and its items' k-th scores are all that the driver gets.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("p_id"), text_of(text_col).alias("p_text"))
    kind = items.schema[item_col].dataType.simpleString()
    keyed = items.select(F.monotonically_increasing_id().alias("q_key"), F.col(item_col).alias("q_item"), text_of(item_text_col).alias("q_text"))
    asked = stored(keyed.mapInArrow(_asked, f"q_key long, q_item {kind}, q_term binary"))
    blocks = -(-asked.count() // block_terms)
    found = [_block(rows, asked.filter(F.pmod(F.xxhash64("q_key"), F.lit(blocks)) == b), k) for b in range(blocks)]
    found = [x for x in found if x is not None]
    if not found:
        forget(asked)
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} {docs.schema[id_col].dataType.simpleString()}, score long")
    named = asked.select("q_key", "q_item").distinct()
    out = reduce(DataFrame.unionByName, found).join(named, "q_key")
    return out.select(F.col("q_item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("p_id").alias(id_col), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS ws FROM benchmark),
 g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_all FROM d WHERE len(ws) > 0),
 m AS (SELECT r, doc_id, 50 + (50 * len(ws)::BIGINT * n_docs) // n_all AS m FROM d, g WHERE len(ws) > 0),
 p AS (SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
 f AS (SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT w, count(*)::BIGINT AS df FROM p GROUP BY w), g),
 s AS (SELECT q, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(ws) AS w FROM i) JOIN f USING (w) JOIN p USING (w) JOIN m USING (r) GROUP BY q, item_id, r, doc_id),
 t AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM t WHERE rank <= 50"""
