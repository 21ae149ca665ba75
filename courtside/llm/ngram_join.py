"""N-gram Jaccard join: extended prefixes with single rare tokens and token combinations, then verification.

The tokens of a document are the 64-bit hashes of its word shingles, in the order of their hashes. Of two documents
whose sets have the Jaccard similarity t, the first n - ceil(t n) + 1 of each, its prefix, share a token. Prefixes that
are k tokens longer share k + 1; k is a fortieth of the set here, so that a passage in common seldom makes a candidate.

1. Rare tokens, held by few extended prefixes, are indexed one by one. A pair is a candidate if the rare tokens that it
   shares, and the frequent ones that it may share, are enough.
2. Of a linked pair that shares no rare token, both prefixes hold more than k frequent ones. The prefixes of such
   documents are extended to their whole sets, and indexed by combinations of tokens (``ngram_tokens.combinations``).
3. Holders of a combination are not paired with each other. They gather around the most typical one, the centre, which
   is compared with all: that is one comparison for each member. Two members that share enough combinations share a centre.
4. Two members of a family that are not both linked to its centre can be linked only if they differ from it in the same
   tokens. So these differences are joined by prefixes again, tokens that no two components share first, the rarest next.
   They tell the overlap of two members exactly, without their texts.

Nothing is capped: families and candidates are as large as the data make them. Links are found for components, so pairs
whose ends are connected already are left out. Hash collisions of 64-bit tokens are the only approximation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import forget, stored, table, text_of
from courtside.llm.graph import components
from courtside.llm.ngram_tokens import EXTENSION, combinations, prefix, tokens

#: Prefixes that hold a token, up to which it is rare; and partners that a document is first verified with.
RARE = 16
PARTNERS = 2
#: Partners that a document is compared with in one go.
SLICE = 32
#: Names of documents that are broadcast at most (8 bytes each).
BROADCAST_ROWS = 1_000_000


def _features(width: int, percent: int):
    """(j_id, j_row, j_text) to (j_id, j_row, j_node, j_n, j_prefix); j_node is the hash of the set, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [tokens(text, width) for text in batch.column("j_text").to_pylist()]
            nodes = np.array([xxhash.xxh3_64_intdigest(own.tobytes()) for own in sets], np.uint64).view(np.int64)
            prefixes = [prefix(own, percent).view(np.int64) for own in sets]
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("j_id"), batch.column("j_row"), pa.array(nodes, pa.int64(), mask=np.array([not len(own) for own in sets], bool)),
                    pa.array([len(own) for own in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())),
                ],
                ["j_id", "j_row", "j_node", "j_n", "j_prefix"],
            )

    return run


def _combined(width: int, percent: int):
    """(j_node, j_text) to a row for each of its two classes: (j_node, j_n, j_class, j_least, j_keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, text in zip(batch.column("j_node").to_pylist(), batch.column("j_text").to_pylist(), strict=True):
                own = tokens(text, width)
                rows += [(node, len(own), number, least, keys) for keys, number, least in combinations(own, percent)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["j_node", "j_n", "j_class", "j_least", "j_keys"])

    return run


def _compared(width: int, percent: int, differences: bool):
    """Rows (a, b, j_text) sorted by a, its own text first (b null), to (a, b, a_n, b_n, linked, added, lost).

    ``added`` are b's tokens that a lacks, ``lost`` the places in a's set of those that b lacks; both empty unless asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, own = None, None
        for batch in batches:
            rows: list[tuple] = []
            for a, b, text in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "j_text")), strict=True):
                other = tokens(text, width)
                if b is None:
                    node, own = a, other
                    continue
                if a != node:
                    raise ValueError("a document came before its centre")
                held = np.isin(own, other, assume_unique=True)
                both = int(held.sum())
                linked = 100 * both >= percent * (len(own) + len(other) - both)
                added, lost = (np.setdiff1d(other, own, assume_unique=True).view(np.int64), np.flatnonzero(~held)) if differences else ((), ())
                rows.append((a, b, len(own), len(other), linked, added, lost))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "a_n", "b_n", "linked", "added", "lost"])

    return run


def compare(pairs: DataFrame, texts: DataFrame, width: int, percent: int, *, differences: bool) -> DataFrame:
    """a, b, a_n, b_n, linked, added, lost of each pair (a, b) of nodes.

    The text of each b travels to its a. A node with many partners is dealt to several slices, each with its own text.
    """
    slices = pairs.groupBy("a").agg(F.expr("cast((count(*) - 1) div {0} + 1 as int)".format(SLICE)).alias("n"))
    sent = pairs.join(slices, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("slice"), "b")
    sent = sent.join(texts.withColumnRenamed("j_node", "b"), "b").select("a", "slice", "b", "j_text")
    own = slices.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"), F.lit(None).cast("long").alias("b"))
    own = own.join(texts.withColumnRenamed("j_node", "a"), "a").select("a", "slice", "b", "j_text")
    rows = sent.unionByName(own).repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
    kind = "a long, b long, a_n long, b_n long, linked boolean, added array<long>, lost array<int>"
    return rows.select("a", "b", "j_text").mapInArrow(_compared(width, percent, differences), kind)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _shared(index: DataFrame) -> DataFrame:
    """Adds j_held, how many rows hold a key, and keeps keys of two or more. The join lets Spark split a hot key."""
    held = index.groupBy("j_key").agg(F.count("*").alias("j_held")).filter("j_held > 1")
    return index.join(held, "j_key")


def _alike(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _differ(sizes: Column, percent: int) -> Column:
    """In how many tokens two linked sets differ at most, by the sum of their sizes."""
    return F.floor(sizes * (100 - percent) / (100 + percent))


def rare_pairs(index: DataFrame, common: DataFrame, percent: int, rare: int) -> DataFrame:
    """Candidates (a, b, j_keys) by single rare tokens of the extended prefixes; a token has ``rare`` holders at most."""
    left, right = (index.filter(F.col("j_held") <= rare).select("j_key", F.col("j_node").alias(x), F.col("j_n").alias(f"{x}_n")) for x in ("a", "b"))
    pairs = left.join(right, "j_key").filter((F.col("a") < F.col("b")) & _alike(F.col("a_n"), F.col("b_n"), percent))
    pairs = pairs.groupBy("a", "b").agg(F.min(F.least("a_n", "b_n")).alias("n"), F.count("*").alias("j_keys"))
    enough = F.floor(F.col("n") / EXTENSION) + 1
    sure, open_ = pairs.filter(F.col("j_keys") >= enough), pairs.filter(F.col("j_keys") < enough)
    for x in ("a", "b"):
        open_ = open_.join(common.select(F.col("j_node").alias(x), F.col("j_many").alias(f"{x}_many")), x)
    return sure.select("a", "b", "j_keys").unionByName(open_.filter(F.col("j_keys") + F.least("a_many", "b_many") >= enough).select("a", "b", "j_keys"))


def memberships(combined: DataFrame, many: DataFrame) -> DataFrame:
    """(a, b): b is a member of the family of centre a. Two linked sets share a family, or one is the other's centre.

    The centre of a key is its holder whose keys are held most in all. Families are ordered by that weight, and a linked
    set shares ``j_least`` keys, so a set may leave out the heaviest families as long as fewer of its keys go with them.
    Among sets without a sure common key, frequent tokens of the extended prefixes are keys, one by one.
    """
    keys = combined.select(F.explode("j_keys").alias("j_key"), "j_node", "j_class", "j_least")
    single = many.select("j_key", "j_node").join(combined.filter("j_least < 1").select("j_node", "j_class"), "j_node")
    single = single.select(F.xxhash64("j_key", "j_class").alias("j_key"), "j_node", "j_class", F.lit(1).alias("j_least"))
    keys = stored(_shared(keys.unionByName(single)))
    weight = keys.groupBy("j_node").agg(F.sum("j_held").alias("j_weight"))
    centres = keys.select("j_key", "j_node").join(weight, "j_node").groupBy("j_key").agg(F.max(F.struct("j_weight", F.col("j_node").alias("a"))).alias("centre"))
    held = keys.join(centres, "j_key").groupBy("j_node", "j_class", "centre").agg(F.count("*").alias("n"), F.max("j_least").alias("j_least"))
    by_weight = Window.partitionBy("j_node", "j_class").orderBy(F.desc("centre"))
    held = held.withColumn("n", F.sum("n").over(by_weight)).filter(F.col("n") >= F.greatest(F.lit(1), "j_least"))
    out = stored(held.select("centre.a", F.col("j_node").alias("b")).filter("a <> b").distinct())
    forget(keys)
    return out


def within_families(family: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """The linked pairs (a, b) of members of one family whose components differ.

    D is the set of tokens in which a member differs from the centre. Linked sets x, y differ in at most r (n_x + n_y)
    tokens, r = (1 - t) / (1 + t), so they share o = (D_x + D_y - r (n_x + n_y)) / 2 of their D at least. A member that
    isn't linked to the centre has D > r (n + n_centre), which makes o positive for all pairs with one. With that, prefixes
    of D, and the places of a shared token in both, decide what is a candidate.
    """
    root = lambda x: roots.select(F.col("j_node").alias(x), F.col("root").alias(f"{x}_root"))
    own = family.join(root("b"), "b", "left").withColumn("root", F.coalesce("b_root", "b"))
    mixed = own.groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("linked").alias("all")).filter("low < high and not all").select("a")
    own = stored(own.join(mixed, "a").select("a", "b", "a_n", "b_n", "root", "linked", (F.size("added") + F.size("lost")).alias("d"), F.concat("added", F.col("lost").cast("array<long>")).alias("tokens")))
    held = own.select("a", "b", "root", F.explode("tokens").alias("t"))
    alive = held.groupBy("a", "t").agg(F.count("*").alias("f"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("a", "t", "f")
    order = held.join(alive, ["a", "t"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("alive"))
    most = _differ(F.col("b_n") + F.floor(F.col("b_n") * 100 / percent), percent)
    first = F.when(F.col("linked"), F.col("d") - F.expr(f"(d * {100 + percent} - (b_n - a_n) * {100 - percent}) div {2 * (100 + percent)}")).otherwise(F.least("d", most + 1))
    sides = stored(own.drop("tokens").join(order, ["a", "b"]).withColumn("dead", F.col("d") - F.size("alive")).withColumn("first", first))
    placed = sides.select("a", "b", "b_n", "root", "linked", "d", "dead", F.posexplode(F.expr("slice(alive, 1, cast(greatest(0, first - dead) as int))")).alias("at", "token"))
    placed = placed.withColumn("rest", F.col("d") - F.col("dead") - F.col("at") - 1).withColumn("t", F.col("token.t"))
    left, right = (placed.select("a", "t", *(F.col(c).alias(f"{x}_{c}") for c in ("b", "b_n", "root", "linked", "d", "rest"))) for x in ("x", "y"))
    least = (F.col("x_d") + F.col("y_d") - _differ(F.col("x_b_n") + F.col("y_b_n"), percent)) / 2
    fits = (F.col("x_b") < F.col("y_b")) & (F.col("x_root") != F.col("y_root")) & ~(F.col("x_linked") & F.col("y_linked"))
    fits = fits & _alike(F.col("x_b_n"), F.col("y_b_n"), percent) & (F.least("x_rest", "y_rest") + 1 >= least)
    found = left.join(right, ["a", "t"]).filter(fits).select("a", F.col("x_b").alias("x"), F.col("y_b").alias("y")).distinct()
    for x in ("x", "y"):
        found = found.join(sides.select("a", F.col("b").alias(x), F.col("b_n").alias(f"{x}_n"), F.col("d").alias(f"{x}_d"), F.col("alive.t").alias(f"{x}_t")), ["a", x])
    shared = (F.col("x_n") + F.col("y_n") - F.col("x_d") - F.col("y_d")) / 2 + F.size(F.array_intersect("x_t", "y_t"))
    out = stored(found.filter(100 * shared >= percent * (F.col("x_n") + F.col("y_n") - shared)).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    forget(own, sides)
    return out


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, rare: int = RARE, partners: int = PARTNERS,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, the smallest id that is reachable by links.

    Two rows are linked if 100 * shared shingles >= ``percent`` * all shingles of both. A text with fewer than ``width``
    words is one shingle; one without words, or null, has none, is linked with nothing, and has its own id. Each row
    is judged by its own text, whatever other rows have its id. A row without an id takes part; its component_id is null if
    no id is reachable. Ids are of any type with an order. An empty table gives an empty result. No other column is read.
    """
    base = docs.select(F.col(id_col).alias("j_id"), text_of(text_col).alias("j_text"))
    base = base.select("j_id", F.xxhash64("j_text").alias("j_row"), "j_text")
    kind = f"j_id {base.schema['j_id'].dataType.simpleString()}, j_row long, j_node long, j_n long, j_prefix array<long>"
    feats = stored(base.mapInArrow(_features(width, percent), kind))

    # equal sets are one node, with the text of one of its rows
    nodes = stored(feats.filter("j_n > 0").groupBy("j_node").agg(F.min("j_n").alias("j_n"), F.min("j_row").alias("j_row"), F.first("j_prefix").alias("j_prefix")))
    index = stored(_shared(nodes.select("j_node", "j_n", F.explode("j_prefix").alias("j_key"))))
    many = index.filter(F.col("j_held") > rare)
    common = many.groupBy("j_node").agg(F.min("j_n").alias("j_n"), F.count("*").alias("j_many"))
    pairs = stored(rare_pairs(index, common, percent, rare))
    # a linked set has at least ``needed`` of this one's tokens, so its own extension is at least that set's
    often = common.filter(F.col("j_many") > F.floor(F.ceil(F.col("j_n") * percent / 100) / EXTENSION)).select("j_node", F.lit(True).alias("often"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("j_node"), F.lit(False).alias("often"))
    asked = ends.unionByName(often).groupBy("j_node").agg(F.max("often").alias("often"))
    asked = stored(asked.join(nodes.select("j_node", "j_row"), "j_node"))
    small = asked.count() <= BROADCAST_ROWS  # else texts and names are both dealt by name
    texts = base.select("j_row", "j_text").join(F.broadcast(asked) if small else asked, "j_row")
    texts = stored(texts.groupBy("j_node").agg(F.first("j_text").alias("j_text"), F.first("often").alias("often")))

    combined = stored(texts.filter("often").mapInArrow(_combined(width, percent), "j_node long, j_n long, j_class int, j_least int, j_keys array<long>"))
    texts_of = texts.select("j_node", "j_text")
    members = memberships(combined, many)
    family = stored(compare(members, texts_of, width, percent, differences=True))
    known = _ordered(family)
    best = Window.partitionBy("b").orderBy(F.desc("j_keys"), "a")
    tried = pairs.withColumn("best", F.row_number().over(best)).filter(F.col("best") <= partners).select("a", "b")
    tried = stored(tried.join(known, ["a", "b"], "left_anti"))
    links = stored(_ordered(family.filter("linked")).unionByName(compare(tried, texts_of, width, percent, differences=False).filter("linked").select("a", "b")).distinct())
    roots = stored(components(links).withColumnRenamed("node", "j_node"))

    # what is still apart: members of a family, and other candidates by rare tokens
    more = within_families(family, roots, percent)
    left = pairs.select("a", "b")
    for x in ("a", "b"):
        left = left.join(roots.select(F.col("j_node").alias(x), F.col("root").alias(f"{x}_root")), x, "left")
    left = left.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    left = stored(left.join(known.unionByName(tried), ["a", "b"], "left_anti"))
    more = stored(more.unionByName(compare(left, texts_of, width, percent, differences=False).filter("linked").select("a", "b")).distinct())
    joined = components(links.unionByName(more)).withColumnRenamed("node", "j_node")
    forget(nodes, index, pairs, asked, texts, combined, members, family, tried, left)

    named = feats.select("j_id", "j_n", "j_node").join(joined, "j_node", "left")
    named = stored(named.select("j_id", "j_n", F.coalesce("root", "j_node").alias("root")))
    smallest = named.filter("root is not null").groupBy("root").agg(F.min("j_id").alias("smallest"))
    forget(feats)
    out = named.join(smallest, "root", "left")
    return out.select(F.col("j_id").alias(id_col), F.col("j_n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("j_id")).otherwise(F.col("smallest")).alias("component_id"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
