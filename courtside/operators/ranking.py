"""Ranks, splits and folds without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_rank(df: DataFrame, bucket: Column, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Adds the row's place from 1 in the order of (bucket, order), which must be unique.

    Rows are numbered within ordered buckets, side by side. The counts of the buckets, one small row each, give every
    bucket its offset. Choose buckets that rise with the order and hold a bounded number of rows.
    """
    rows = df.withColumn("r_bucket", bucket)
    before = Window.orderBy("r_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("r_bucket").count().select("r_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("r_start"))
    local = F.row_number().over(Window.partitionBy("r_bucket").orderBy(*order))
    return rows.withColumn("r_local", local).join(starts, "r_bucket").withColumn(name, F.col("r_local") + F.col("r_start")).drop("r_bucket", "r_local", "r_start")


def hash_order(key: str, seed: int) -> Column:
    """A shuffle that any engine repeats: md5 of the seed and the key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def hash_split(df: DataFrame, key: str, ratios: dict[str, float], seed: int = 42, cap: int | None = None, digits: int = 3) -> DataFrame:
    """Adds split: exact cuts at int(n * ratio) of the hashed order, the last split takes the rest.

    With ``cap``, the first ``cap`` rows of that order are split and the others go. Rows are ranked in 16 ** ``digits``
    buckets side by side; one digit more for each 16 times the rows keeps the buckets as small.
    """
    rows = global_rank(df.withColumn("r_hash", hash_order(key, seed)), F.substring("r_hash", 1, digits), ["r_hash", key])
    total = df.agg(F.count("*").alias("r_n"))
    if cap is not None:
        rows, total = rows.filter(F.col("rank") <= cap), total.withColumn("r_n", F.least("r_n", F.lit(cap)))
    rows = rows.join(F.broadcast(total))  # one row
    names, edge, out = list(ratios), F.lit(0).cast("long"), F.lit(list(ratios)[-1])
    cuts = []
    for name in names[:-1]:
        edge = edge + F.floor(F.col("r_n") * ratios[name])
        cuts.append((name, edge))
    for name, edge in reversed(cuts):
        out = F.when(F.col("rank") <= edge, name).otherwise(out)
    return rows.withColumn("split", out).drop("r_hash", "r_n")


def time_split(df: DataFrame, bucket: Column, order: Sequence[str], share: float = 0.8) -> DataFrame:
    """Adds split: train for the first int(share * n) rows in order, else test."""
    rows = global_rank(df, bucket, order)
    rows = rows.join(F.broadcast(df.agg(F.count("*").alias("r_n"))))  # one row
    return rows.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("r_n") * share), "train").otherwise("test")).drop("r_n")


def group_folds(df: DataFrame, group: str, label: str, folds: int = 3, bucket: Column | None = None) -> DataFrame:
    """group, n_rows, n_positive, fold: whole groups dealt so that folds hold alike many rows of either class.

    Groups in falling order of their positives, then rows, go back and forth over the folds. This needs only the groups'
    ranks, so it stays a distributed sort of the group table. Groups of equal counts are ranked together unless
    ``bucket``, which must rise with the group's own order, parts them.
    """
    groups = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_positive"))
    ranked = global_rank(groups, F.struct(-F.col("n_positive"), -F.col("n_rows"), F.lit(0) if bucket is None else bucket), [F.asc(group)])
    at = F.pmod(F.col("rank") - 1, F.lit(2 * folds))
    return ranked.withColumn("fold", F.when(at < folds, at).otherwise(2 * folds - 1 - at).cast("int")).drop("rank")


#: Kinds of groups, by their counts, that are dealt one after the other; more go back and forth over the folds.
KINDS = 200_000
#: Groups of a kind per fold that are dealt one by one; what is above goes to all folds alike.
ONE_BY_ONE = 50


def dealt(kinds: Sequence[tuple[int, int, int]], folds: int) -> list[list[int]]:
    """For each kind (rows, positives, groups), how many of its groups each fold gets.

    One group at a time goes where the squares of the folds' shares of either class grow least, then to the fold with fewer
    rows, then to the first. Kinds come in the order given; equal parts of a large kind, which change no difference between
    folds, come first.
    """
    rows, positives = sum(n * m for n, _, m in kinds), sum(p * m for _, p, m in kinds)
    heavy, light = max(1, positives) ** 2, max(1, rows - positives) ** 2
    held, out = [[0, 0] for _ in range(folds)], []
    for n, p, groups in kinds:
        even = max(0, groups // folds - ONE_BY_ONE)
        quota = [even] * folds
        for fold in held:
            fold[0] += even * (n - p)
            fold[1] += even * p
        for _ in range(groups - even * folds):
            at = min(range(folds), key=lambda i: (held[i][0] * (n - p) * heavy + held[i][1] * p * light, held[i][0] + held[i][1], i))  # noqa: B023
            quota[at] += 1
            held[at][0] += n - p
            held[at][1] += p
        out.append(quota)
    return out


def stratified_folds(df: DataFrame, group: str, label: str, folds: int = 3, digits: int = 2) -> DataFrame:
    """group, n_rows, n_positive, fold: whole groups, each dealt with regard to what the folds hold so far.

    Groups in falling order of how far apart their classes are, then of rows and positives. Groups of equal counts are one
    kind: the driver deals a table of kinds, not of groups, and the groups of a kind take its quotas in the order of their
    hash. With more than KINDS kinds, which it doesn't collect, ``group_folds`` deals.
    """
    groups = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_positive"))
    kinds = groups.groupBy("n_rows", "n_positive").count()
    apart = F.abs(2 * F.col("n_positive") - F.col("n_rows"))
    first = kinds.orderBy(apart.desc(), F.desc("n_rows"), F.desc("n_positive")).limit(KINDS + 1).collect()
    if len(first) > KINDS:
        return group_folds(df, group, label, folds)
    cuts = [(r[0], r[1], [sum(q[: i + 1]) for i in range(folds)]) for r, q in zip(first, dealt([tuple(r) for r in first], folds), strict=True)]
    quotas = df.sparkSession.createDataFrame(cuts, "n_rows long, n_positive long, cuts array<long>")
    named = groups.withColumn("r_hash", hash_order(group, 0))
    # ranks within a kind: a kind's own start is the smallest rank that it has
    ranked = global_rank(named, F.struct("n_rows", "n_positive", F.substring("r_hash", 1, digits)), ["r_hash", group])
    starts = ranked.groupBy("n_rows", "n_positive").agg(F.min("rank").alias("r_first"))
    placed = ranked.join(starts, ["n_rows", "n_positive"]).join(quotas, ["n_rows", "n_positive"])
    return placed.select(group, "n_rows", "n_positive", F.size(F.filter("cuts", lambda c: c <= F.col("rank") - F.col("r_first"))).alias("fold"))


def rank_slice(df: DataFrame, bucket: Column, order: Sequence[str | Column], start: int, count: int) -> DataFrame:
    """The rows of ranks start to start + count - 1, with rank. Only the buckets that these fall into are sorted."""
    rows = df.withColumn("r_bucket", bucket)
    before = Window.orderBy("r_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("r_bucket").agg(F.count("*").alias("r_n")).withColumn("r_start", F.coalesce(F.sum("r_n").over(before), F.lit(0)))
    starts = starts.filter((F.col("r_start") < start + count - 1) & (F.col("r_start") + F.col("r_n") >= start)).drop("r_n")
    local = F.row_number().over(Window.partitionBy("r_bucket").orderBy(*order))
    ranked = rows.join(starts, "r_bucket").withColumn("rank", local + F.col("r_start")).drop("r_bucket", "r_start")
    return ranked.filter(F.col("rank").between(start, start + count - 1))


def most_common(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, n: the most frequent value of each key, the smallest of those that tie. Nulls don't count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    most = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    return counts.join(most, [*keys, "n"]).groupBy(*keys, "n").agg(F.min(value).alias(value)).select(*keys, value, "n")


def latest_row(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """The columns of each key's last row: a max_by, so rows combine before they are exchanged."""
    best = F.max_by(F.struct(*columns), order).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, "r.*")
