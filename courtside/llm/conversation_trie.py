"""The prefix trie of conversations, from padded matrices of turn ids.

Each distinct sequence of turns is a row with the number of its conversations. The rows are dealt to shards by ranges of
their order. A shard is a matrix of turn ids, padded to its longest row and sorted by numpy's lexsort. Where a row changes
against the one above, in this column or (OR-accumulated) one before, a node starts; the rows of a node follow each other,
so reduceat sums every depth at once. Only the nodes on the first and the last row of a shard can go on in its neighbours;
how deep they do is known from the neighbours' border rows. Such nodes leave their shards in parts, which are put together
by their path.

Ids of turns are 64-bit hashes, and equal sequences are found by 96 bits; collisions are the only approximation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import WORD, forget, stored, table, text_of

#: Turns of a shard on average, and cells of a padded matrix; wider ones are sorted in bands of columns.
SHARD_TURNS, CELLS = 1_000_000, 8_000_000
#: Nodes in several shards that are broadcast at most (about 40 bytes each).
BROADCAST_ROWS = 1_000_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = "shard int, key binary, depth long, conv_id long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, spans boolean, goes_on boolean"


def turn_lists(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """c_id, c_turns (ids), c_words (words of each turn) of every conversation, in the order of turns, null first.

    Rows of one turn number are ordered by their ids. Texts don't travel: a conversation is one row of 12 bytes a turn.
    """
    turn = F.xxhash64(text_of(role_col), text_of(text_col))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c_id"), F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("at"), turn.alias("id"), F.regexp_count(text_of(text_col), F.lit(WORD)).alias("words"),
    )
    listed = rows.groupBy("c_id").agg(F.array_sort(F.collect_list(F.struct("known", "at", "id", "words"))).alias("turns"))
    return listed.select("c_id", F.col("turns.id").alias("c_turns"), F.col("turns.words").alias("c_words"))


def with_heads(lists: DataFrame, base: Column, turns: Column, most: int) -> DataFrame:
    """Conversations whose first ``turns`` (at most ``most``) turns are those of the conversation ``base``, if there is one."""
    heads = lists.select(F.col("c_id").alias("h_id"), *(F.slice(c, 1, most).alias(f"h{c[1:]}") for c in ("c_turns", "c_words")))
    met = lists.withColumns({"c_base": base, "c_head": turns.cast("int")}).join(heads, F.col("c_base") == F.col("h_id"), "left")
    own = lambda c: F.slice(c, F.col("c_head") + 1, F.greatest(F.size(c), F.lit(1)))
    head = lambda c, kind: F.coalesce(F.slice(c, F.lit(1), F.col("c_head")), F.array().cast(f"array<{kind}>"))
    return met.select("c_id", F.concat(head("h_turns", "long"), own("c_turns")).alias("c_turns"), F.concat(head("h_words", "int"), own("c_words")).alias("c_words"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (s1, s2, c_id) in order to a row for each run of a sequence's conversations: (s1, s2, low, n, piece)."""
    for batch in batches:
        s1, s2, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s1", "s2", "c_id"))
        if not len(ids):
            continue
        starts = np.flatnonzero(np.concatenate(([True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))))
        ends, names = np.append(starts[1:], len(ids)), list(map(str, ids.tolist()))
        pieces = [",".join(names[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (s1[starts], s2[starts], ids[starts], ends - starts)), pa.array(pieces, pa.string())], ["s1", "s2", "low", "n", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to (s1, s2, low, n, ends): a sequence's pieces stream through one hash, whatever their number."""
    key, state, low, n = None, None, None, 0
    for batch in batches:
        rows = []
        for s1, s2, first, count, piece in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "low", "n", "piece")), strict=True):
            if (s1, s2) == key:
                state.update(b",")
            else:
                if key is not None:
                    rows.append((*key, low, n, state.hexdigest()))
                key, state, low, n = (s1, s2), hashlib.sha256(), first, 0
            state.update(piece.encode())
            n += count
        yield _rows(rows)
    if key is not None:
        yield _rows([(*key, low, n, state.hexdigest())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["s1", "s2", "low", "n", "ends"])


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... counts[1] - 1, and so on."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def ordered(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): rows in lexicographic order, and how many columns each has in common with the one above (-1 for none).

    Codes are above 0, the padding. The matrix is built in bands of at most ``cells`` cells; rows that no other equals in
    all bands so far are in place already.
    """
    n = len(lengths)
    order, shared, group = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_, low, widest = np.arange(n), 0, int(lengths.max(initial=0))
    while len(open_) > 1 and low < widest:
        width = max(1, min(widest - low, cells // len(open_)))
        rows = order[open_]
        filled = np.clip(lengths[rows] - low, 0, width)
        matrix, column = np.zeros((len(rows), width), codes.dtype), _spread(filled)
        matrix[np.repeat(np.arange(len(rows)), filled), column] = codes[np.repeat(starts[rows] + low, filled) + column]
        sort = np.lexsort((*(matrix[:, c] for c in range(width - 1, -1, -1)), group[open_]))
        order[open_], matrix, held = rows[sort], matrix[sort], group[open_]
        changed = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
        changed[held[1:] != held[:-1]] = True
        shared[open_[1:]] += (~changed).sum(axis=1)
        tied = np.concatenate(([False], ~changed[:, -1]))
        group[open_] = open_[np.maximum.accumulate(np.where(tied, 0, np.arange(len(open_))))]
        open_, low = open_[tied | np.append(tied[1:], False)], low + width
    shared[:1] = -1
    return order, shared


def shard_nodes(shard: int, turns: pa.ListArray, words: pa.ListArray, convs: np.ndarray, lows: np.ndarray, ends: pa.Array, before: int, after: int, cells: int = CELLS) -> pa.Table:
    """All nodes of a shard's sequences. Nodes of up to ``before`` turns on the first row, and of up to ``after`` on the last
    one, go on in a neighbour: they span, and what is returned are the shard's parts of them, without what other such nodes
    save.
    """
    n, lengths = len(turns), np.diff(turns.offsets.to_numpy())
    flat = turns.flatten().to_numpy(zero_copy_only=False)
    codes = (np.unique(flat, return_inverse=True)[1] + 1).astype(np.int32)
    order, shared = ordered(codes, np.cumsum(lengths) - lengths, lengths, cells)
    first_turn, lengths, convs, lows, ends = (np.cumsum(lengths) - lengths)[order], lengths[order], convs[order], lows[order], ends.take(pa.array(order))
    below = np.append(shared[1:], -1)
    heard = np.concatenate(([0], np.cumsum(words.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)))
    # how deep each row's nodes are those of the first and of the last row, and whether they span
    endless = np.iinfo(np.int64).max
    with_first = np.minimum.accumulate(np.concatenate(([endless], shared[1:])))
    with_last = np.minimum.accumulate(np.concatenate(([endless], shared[:0:-1])))[::-1]
    on_first, on_last = np.minimum(before, with_first), np.minimum(after, with_last)
    limit = np.maximum(on_first, on_last)
    leaf = below < lengths
    leaf[-1] &= after < lengths[-1]

    # nodes of one row each: those below what it shares with its neighbours
    alone = np.maximum(shared, below) + 1
    count = lengths - alone + 1
    row = np.repeat(np.arange(n), count)
    depth = np.repeat(alone, count) + _spread(count)
    end = heard[first_turn + lengths]
    saved = (convs[row] - 1) * (end[row] - heard[first_turn[row] + np.maximum(np.maximum(depth, limit[row] + 1), 1) - 1].clip(max=end[row]))
    parent = np.where(depth > alone[row], lows[row], -1)
    parts = [(row, depth, convs[row], lows[row], parent, depth < lengths[row], leaf[row], saved)]
    top, has = np.cumsum(count) - count, count > 0

    # nodes of several rows, deepest first; what lies below a row is added to it as it goes
    value = (convs - 1) * (end - heard[np.minimum(first_turn + np.maximum(np.maximum(alone, limit + 1), 1) - 1, first_turn + lengths)])
    by_alone = np.argsort(alone, kind="stable")
    sorted_alone = alone[by_alone]
    waiting = None
    for d in range(int(shared.max()), -1, -1):
        joined = np.flatnonzero(shared >= d)
        if not len(joined):
            break
        gap = np.flatnonzero(np.diff(joined) > 1)
        firsts, lasts = joined[np.concatenate(([0], gap + 1))] - 1, joined[np.append(gap, len(joined) - 1)]
        cuts = np.column_stack((firsts, lasts + 1)).ravel()
        sums = lambda x, by=np.add: by.reduceat(np.append(x, x[-1]), cuts)[::2]  # noqa: B023, E731
        in_all, least = sums(convs), sums(lows, np.minimum)
        if d:
            own = (in_all - 1) * (heard[first_turn[firsts] + d] - heard[first_turn[firsts] + d - 1])
            value[firsts] += np.where(d > limit[firsts], own, 0)
        new = shared == d
        new[firsts] = lengths[firsts] > d
        parts.append((firsts, np.full(len(firsts), d), in_all, least, np.full(len(firsts), -1), sums(new.astype(np.int64)), sums(leaf.astype(np.int64)), sums(value)))
        held = lambda rows: least[np.searchsorted(firsts, rows, side="right") - 1]  # noqa: B023, E731
        if waiting is not None:
            waiting[4][:] = held(waiting[0])
        waiting = parts[-1]
        tops = by_alone[np.searchsorted(sorted_alone, d + 1) : np.searchsorted(sorted_alone, d + 1, side="right")]
        tops = tops[has[tops]]
        parent[top[tops]] = held(tops)

    row, depth, in_all, least, parent, children, leaves, saved = (np.concatenate([np.asarray(p[i], np.int64) for p in parts]) for i in range(8))
    paths = [_path(flat[first_turn[r] : first_turn[r] + lengths[r]], most) for r, most in ((0, before), (n - 1, after))]
    keys = pa.array([*paths[0], *paths[1], None], pa.binary())

    def key(depths: np.ndarray) -> pa.Array:
        place = np.where(depths < 0, len(keys) - 1, np.where(depths <= on_first[row], depths, np.where(depths <= on_last[row], len(paths[0]) + depths, len(keys) - 1)))
        return keys.take(pa.array(place))

    spans, up = depth <= limit[row], depth - 1 <= limit[row]
    ended = np.where(depth == lengths[row], row, n)
    ends = pa.chunked_array([ends, pa.array([None], pa.string())]).combine_chunks()
    heard_here = heard[first_turn[row] + depth] - heard[first_turn[row] + np.maximum(depth - 1, 0)]
    columns = [
        pa.array(np.full(len(row), shard, np.int32)), key(depth), pa.array(depth), pa.array(least), pa.array(parent, mask=up | (depth == 0)), key(depth - 1), pa.array(in_all), pa.array(children),
        pa.array(leaves), pa.array(saved), pa.array(heard_here), ends.take(pa.array(ended)), pa.array(spans), pa.array(depth <= on_last[row]),
    ]
    return pa.table(columns, names=[c.split()[0] for c in _NODE.split(", ")])


def _path(turns: np.ndarray, most: int) -> list[bytes]:
    """Names of the prefixes of 0 to ``most`` turns."""
    out, state = [], hashlib.md5(b"", usedforsecurity=False)
    for at in range(most + 1):
        if at:
            state.update(turns[at - 1].tobytes())
        out.append(state.digest())
    return out


def _shard(rows: pa.Table, border: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    shard, before, after = (border.column(c)[0].as_py() for c in ("shard", "before", "after"))
    lists = [rows.column(c).chunk(0) if rows.column(c).num_chunks else rows.column(c).combine_chunks() for c in ("c_turns", "c_words")]
    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)), x.flatten()) for x in lists]
    convs, lows = (rows.column(c).to_numpy() for c in ("n", "low"))
    return shard_nodes(shard, *lists, convs, lows, rows.column("ends").combine_chunks(), before, after)


def _common(a: str, b: str) -> Column:
    """How many leading elements two arrays have in common; null if one is null."""
    most = f"least(size({a}), size({b}))"
    return F.expr(f"coalesce(nullif(array_position(zip_with(slice({a}, 1, {most}), slice({b}, 1, {most}), (x, y) -> x = y), false), 0) - 1, {most})")


def trie(lists: DataFrame, *, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of conversations (c_id, c_turns, c_words); see ``prefix_trie``."""
    spark = lists.sparkSession
    named = stored(lists.withColumns({"s1": F.xxhash64("c_turns"), "s2": F.hash("c_turns")}))
    # every sequence's conversations in numeric order: pieces of ranges, which stream through a hash
    pieces = named.select("s1", "s2", "c_id").repartitionByRange("s1", "s2", "c_id").sortWithinPartitions("s1", "s2", "c_id").mapInArrow(_pieces, "s1 long, s2 int, low long, n long, piece string")
    hashed = pieces.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "low").mapInArrow(_hashed, "s1 long, s2 int, low long, n long, ends string")
    distinct = stored(named.groupBy("s1", "s2").agg(F.first("c_turns").alias("c_turns"), F.first("c_words").alias("c_words")).join(hashed, ["s1", "s2"]).drop("s1", "s2"))
    turns = distinct.agg(F.sum(F.size("c_turns") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    dealt = stored(distinct.repartitionByRange(shards, "c_turns").withColumn("shard", F.spark_partition_id()))

    # one row a shard: how deep its first row's nodes are in the shard before, and its last row's in the one after; -1 for no such shard
    along = Window.orderBy("shard")
    borders = dealt.groupBy("shard").agg(F.min("c_turns").alias("low"), F.max("c_turns").alias("high"))
    borders = borders.withColumns({"above": F.lag("high").over(along), "below": F.lead("low").over(along)})
    borders = borders.select("shard", *(F.coalesce(F.when(F.col(b).isNotNull(), _common(a, b)), F.lit(-1)).cast("long").alias(c) for a, b, c in (("low", "above", "before"), ("high", "below", "after"))))
    nodes = stored(dealt.groupBy("shard").cogroup(borders.groupBy("shard")).applyInArrow(_shard, _NODE))
    forget(named, distinct, dealt)

    whole, parts = nodes.filter("not spans"), nodes.filter("spans")
    both = parts.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"), F.min(F.when(F.col("goes_on"), F.col("shard"))).alias("counted_at"),
    )
    both = stored(both)
    # a child in several shards is one child
    inner = parts.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg((F.count_distinct("key") - F.count("*")).alias("twice"))
    # what spanning nodes save counts once, at the first border they cross, and for all nodes above them there
    saves = F.when(F.col("shard") == F.col("counted_at"), (F.col("n_convs") - 1) * F.col("words")).otherwise(0)
    crossing = parts.filter("goes_on").select("shard", "key", "depth").join(both.select("key", "n_convs", "words", "counted_at"), "key")
    crossing = crossing.withColumn("more", F.sum(saves).over(Window.partitionBy("shard").orderBy(F.desc("depth"))))
    more = crossing.groupBy("key").agg(F.sum("more").alias("more"))
    parents = both.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("spanning_parent"))
    parents = F.broadcast(parents) if both.count() <= BROADCAST_ROWS else parents  # else both sides are dealt by key, and a hot one is split
    joined = both.join(inner, "key", "left").join(more, "key", "left").withColumns({"n_children": F.col("n_children") + F.coalesce("twice", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("more", F.lit(0))})
    columns = ["conv_id", "depth", "parent_key", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = whole.select(columns).unionByName(joined.withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    return out.join(parents, "parent_key", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "spanning_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node, each distinct sequence of first turns (role, text) of the conversations, from the root of no turns.

    conv_id is the smallest conversation that begins so, depth the number of turns, parent_conv_id the parent's conv_id
    (null for the root), n_convs the conversations that begin so, n_children the nodes one turn longer, n_leaves the
    childless nodes below, n itself included; saved_tokens sums (n_convs - 1) times the words of its last turn over the node
    and all below; ends_sha256 is the SHA-256 of the ids of those that end here, in numeric order, joined by commas.

    Turns are ordered by number, null first, then by the hash of role and text; null roles and texts count as empty.
    Repeated rows are turns of their own. Rows without a conversation take no part. An empty table has no nodes. Other
    columns are not read. A conversation's turn ids are one row, whose length is the only group that isn't split.
    """
    return trie(turn_lists(conversations, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col), shard_turns=shard_turns)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = F.col("c_id") - F.col("c_id") % 20, F.crc32(F.col("c_id").cast("string").cast("binary")) % 4
    return trie(with_heads(turn_lists(table(spark, sf_dir, "conversations")), base, head, 3))


ORACLE = """
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS v FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
 crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
 own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
 h AS (SELECT o.conv_id, o.turns, b.turns AS head, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(o.conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, c: xor(s // 256, t[1 + xor(s % 256, c)]))) % 4 AS n
  FROM own o CROSS JOIN crc LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
 c AS (SELECT conv_id, list_concat(CASE WHEN n = 0 THEN [] ELSE coalesce(head[1:n], []) END, turns[n + 1:]) AS turns FROM h),
 p AS (SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE turns[1:d] END AS path, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM c)),
 n AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[d].text, '[^\\x20\\x09-\\x0D]+')) END AS saves FROM p GROUP BY d, path),
 k AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND m.path[1:n.d] = n.path) AS n_children FROM n WHERE d > 0 UNION ALL SELECT n.*, (SELECT count(*) FROM n m WHERE m.d = 1) FROM n WHERE d = 0),
 a AS (SELECT CASE WHEN e = 0 THEN [] ELSE path[1:e] END AS path, e AS d, saves, n_children FROM (SELECT *, unnest(range(d + 1)) AS e FROM k)),
 s AS (SELECT d, path, sum(saves) AS saved, sum((n_children = 0)::INTEGER) AS leaves FROM a GROUP BY d, path)
SELECT k.conv_id, k.d AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s ON s.d = k.d AND s.path = k.path LEFT JOIN n u ON u.d = k.d - 1 AND u.path = (CASE WHEN k.d = 1 THEN [] ELSE k.path[1:k.d - 1] END)"""
