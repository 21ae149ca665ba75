"""Mixing sources to target weights by entropy balancing.

Documents get the rates r that are closest to 1 in relative entropy, sum(r log r - r), while the words of every source meet
its target. The solution is an exponential tilt, r = exp(lambda * size) with one multiplier per source, cut at the most
that a document may be repeated. The convex dual in all multipliers is solved by Newton's method: each step sums the
gradient and the curvature of every source over its documents, in one grouped aggregation, until all targets are met.
Rates are then rounded into copies, so that the words taken from a source stay near its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import forget, stored, table, text_of, words_of

WEIGHTS = (5, 2, 1)
#: A target and a document's copies stop at so many times the source's, or the document's, size.
MOST = 3
#: Newton's method ends when all sources' words are within this share of their targets, and a tenth of a word.
TOLERANCE = 1e-9
#: Words are summed in whole units of this share, so that sums are exact and reruns agree.
UNIT = 2.0**-20
#: A document above this share of its source's words is rounded on its own; a source has fewer than 1 / share of them.
HEAVY = 0.004
#: Rows of a source that are sorted together; a larger source is dealt to more groups. It only bounds a task's sort. The
#: more groups there are, the more of their rounding errors, each at most a light document, cancel out.
GROUP_ROWS = 2_000


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """m_id, m_source, m_key (never null), m_size in words."""
    source = F.col(source_col).cast("string")
    return docs.select(F.col(id_col).alias("m_id"), source.alias("m_source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("m_key"), F.size(words_of(text_of(text_col))).cast("long").alias("m_size"))


def _ranked(per: DataFrame) -> DataFrame:
    """Adds m_rank from 0, by code point, null last; ranges of sources are numbered side by side, whatever their number."""
    null_last = F.col("m_source").isNull()
    ranged = stored(per.repartitionByRange(null_last, F.col("m_source")).withColumn("m_range", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("m_range").orderBy(null_last, "m_source")).cast("long") - 1
    before = Window.orderBy("m_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per shuffle partition
    starts = ranged.groupBy("m_range").count().select("m_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("m_start"))
    return ranged.withColumn("m_local", local).join(F.broadcast(starts), "m_range").withColumn("m_rank", F.col("m_local") + F.col("m_start")).drop("m_range", "m_local", "m_start")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: m_key, source_size, m_docs, m_rank, target.

    Sources in order weigh ``weights``, repeating. The words of all sources are shared by weight; a target stops at
    ``most`` times its source's size, and what is over is shared by weight again until no target is above. The level
    (words per weight) only rises, so each round needs one sum over the sources.
    """
    per = sized.groupBy("m_key").agg(F.first("m_source").alias("m_source"), F.sum("m_size").alias("source_size"), F.count("*").alias("m_docs"))
    per = stored(_ranked(per).withColumn("m_weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("m_rank") % len(weights) + 1).cast("int"))))
    top = F.col("source_size") * most
    level, capped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("m_weight") > top
        total, at_top, free, now = per.agg(F.sum("source_size"), F.coalesce(F.sum(F.when(over, top)), F.lit(0)), F.sum(F.when(~over, F.col("m_weight"))), F.count_if(over)).first()
        if now == capped or not total or not free:
            break
        level, capped = (total - at_top) / free, now
    return per.withColumn("target", F.least(F.lit(level) * F.col("m_weight"), top.cast("double"))).drop("m_weight", "m_source")


def rate_of(size: Column, tilt: Column, full: Column, most: float = MOST) -> Column:
    """A document's rate: exp(tilt * size), ``most`` at the most or if all of its source is taken that often; 1 without words."""
    return F.when(size <= 0, 1.0).when(full, float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(tilt * size, F.lit(700.0)))))


def tilts(sized: DataFrame, per: DataFrame, most: float = MOST) -> DataFrame:
    """Adds m_tilt and m_full to the rows of ``per``: the dual's solution, by Newton steps over the documents.

    Documents of one size share their rate, so the sums run over the (source, size) counts. A step that leaves the
    interval in which a source's multiplier is known to lie is replaced by its middle, or doubled while it has one end only.
    """
    counts = stored(sized.filter("m_size > 0").groupBy("m_key", "m_size").agg(F.count("*").alias("n")))
    mean = F.greatest(F.col("source_size"), F.lit(1)) / F.greatest(F.col("m_docs"), F.lit(1))
    full, none = F.col("target") >= most * F.col("source_size") * (1 - 1e-12), F.lit(None).cast("double")
    at = stored(per.select("m_key", "target", mean.alias("mean"), F.lit(0.0).alias("tilt"), none.alias("low"), none.alias("high"), (full | (F.col("source_size") <= 0)).alias("done"), full.alias("m_full")))
    while True:
        rate = rate_of(F.col("m_size"), F.col("tilt") / F.col("mean"), F.lit(False), most)
        words = lambda x: F.sum(F.round(x / UNIT).cast("decimal(38,0)")).cast("double") * UNIT
        sums = counts.join(at.filter("not done"), "m_key").groupBy("m_key").agg(
            words(F.col("n") * F.col("m_size") * rate).alias("taken"),
            words(F.when(rate < most, F.col("n") * F.col("m_size") * rate * F.col("m_size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        step = at.join(sums, "m_key", "left").withColumn("gap", F.col("taken") - F.col("target"))
        step = step.withColumns({"low": F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high"))})
        newton = F.col("tilt") - F.try_divide("gap", "slope")
        inside = newton.isNotNull() & (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf"))))
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, F.col("low") + F.greatest(F.lit(1.0), F.abs("low")), F.col("high") - F.greatest(F.lit(1.0), F.abs("high")))
        moved = F.when(inside, newton).otherwise(middle)
        done = F.col("done") | (F.abs("gap") <= TOLERANCE * F.col("target") + 0.1) | (F.abs(moved - F.col("tilt")) <= 1e-15 * F.abs("tilt"))
        last, at = at, stored(step.select("m_key", "target", "mean", F.when(done, F.col("tilt")).otherwise(moved).alias("tilt"), "low", "high", done.alias("done"), "m_full"))
        forget(last)
        if not at.filter("not done").limit(1).count():
            break
    return per.join(at.select("m_key", (F.col("tilt") / F.col("mean")).alias("m_tilt"), "m_full"), "m_key")


def copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per input row: id, m_key, size, source_size, target, rate, copies.

    A source's few heavy documents are rounded one after another, largest first, each making up for what the ones
    before it took too much or too little. All others share what is left. They are rounded in the order of their sizes: one
    gets a further copy where the sum of the rates' fractions passes a whole number. So a source's words differ from its
    target by little more than half its largest light document.

    Null text has size 0 and is taken once, which adds no words; a null source is a source of its own, the last one. Repeated
    rows and null ids get one result row each. If there are no words, all targets are 0. An empty table gives an empty
    result. Other columns of the input are not read.
    """
    sized = stored(sizes(docs, id_col, text_col, source_col))
    per = tilts(sized, stored(targets(sized, weights, most)), most)
    per = stored(per.withColumn("m_groups", F.ceil(F.col("m_docs") / group_rows)).select("m_key", "source_size", "target", "m_tilt", "m_full", "m_groups"))
    rate = F.round(rate_of(F.col("m_size"), F.col("m_tilt"), F.col("m_full"), most), 12)
    joined = sized.drop("m_source").join(per, "m_key").withColumn("rate", rate).drop("m_tilt", "m_full")
    heavy = F.col("m_size") > HEAVY * F.col("source_size")

    # fewer than 1 / HEAVY documents of each source: (size, id, rate) and, by the same place, their copies
    bulk = joined.filter(heavy).groupBy("m_key").agg(F.sort_array(F.collect_list(F.struct("m_size", "m_id", "rate")), asc=False).alias("m_bulk"))
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<double>").alias("copies"))

    def take(state: Column, doc: Column) -> Column:
        low = F.floor(doc["rate"]).cast("double")
        owed = state["owed"] + (doc["rate"] - low) * doc["m_size"]
        more = F.when((doc["rate"] > low) & (owed * 2 >= doc["m_size"]), 1.0).otherwise(0.0)
        return F.struct((owed - more * doc["m_size"]).alias("owed"), F.concat(state["copies"], F.array(low + more)).alias("copies"))

    bulk = bulk.withColumn("m_done", F.aggregate("m_bulk", start, take))
    bulk = stored(bulk.select("m_key", F.col("m_done.owed").alias("m_owed"), F.arrays_zip("m_bulk", "m_done.copies").alias("m_each"), F.aggregate("m_bulk", F.lit(0).cast("long"), lambda s, d: s + d["m_size"]).alias("m_words")))
    one = bulk.select("m_key", F.explode("m_each").alias("e")).select("m_key", F.col("e.m_bulk.m_id").alias("m_id"), F.col("e.m_bulk.m_size").alias("m_size"), F.col("e.m_bulk.rate").alias("rate"), F.col("e.copies").cast("long").alias("copies"))
    one = one.join(per, "m_key").select("m_id", "m_key", "m_size", "source_size", "target", "rate", "copies")

    light = joined.filter(~heavy).join(bulk.select("m_key", "m_owed", "m_words"), "m_key", "left")
    rest = F.col("source_size") - F.coalesce("m_words", F.lit(0))
    own = F.when(rest > 0, F.least(F.greatest(F.col("rate") + F.coalesce("m_owed", F.lit(0.0)) / rest, F.lit(0.0)), F.lit(float(most)))).otherwise(0.0)
    light = light.withColumns({"m_rate": own, "m_group": F.pmod(F.xxhash64("m_id", "m_size"), F.col("m_groups"))})
    # whole parts of 2**-40, so that the order of summing doesn't matter; groups of a large source start at different phases
    part = F.round((F.col("m_rate") - F.floor("m_rate")) * 2.0**40).cast("decimal(38,0)")
    upto = F.sum("m_part").over(Window.partitionBy("m_key", "m_group").orderBy("m_size", "m_id").rowsBetween(Window.unboundedPreceding, 0))
    phase = (F.col("m_group") + 0.5) / F.col("m_groups")
    light = light.withColumn("m_part", part).withColumn("m_upto", upto)
    passed = lambda x: F.floor(x.cast("double") / 2.0**40 + phase)
    light = light.withColumn("copies", (F.floor("m_rate") + passed(F.col("m_upto")) - passed(F.col("m_upto") - F.col("m_part"))).cast("long"))
    both = one.unionByName(light.select("m_id", "m_key", "m_size", "source_size", "target", "rate", "copies"))
    return both.select(F.col("m_id").alias(id_col), "m_key", F.col("m_size").alias("size"), "source_size", "target", "rate", "copies")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate")
