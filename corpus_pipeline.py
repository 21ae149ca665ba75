"""The corpus pipeline: five stages over ``documents``, each of them one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next stage's documents. All stages but the last return the columns of ``documents`` and ``row_key``, which the first
one adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm.bpe import encode_digests
from courtside.llm.common import stored, table
from courtside.llm.mixing import copies
from courtside.llm.ngram_join import jaccard_components
from courtside.llm.quality import quality_rules
from courtside.llm.secret_scan import redact_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Each input row's own key, by which stages decide and join.
KEY = "row_key"
#: Near duplicates: shingles of five words, four fifths of both sets in common.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


#: Rows that Spark hands to a Python worker at once. A worker keeps what its largest batch took, beside the JVM's own memory.
BATCH_ROWS = "500"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of each row's own; ids may be null or repeat. A new key is stored, so that it stays."""
    if KEY in docs.columns:
        return docs.select(*COLUMNS, KEY)
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(KEY)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row judged by its own text."""
    rows = keyed(docs)
    kept = quality_rules(rows, id_col=KEY).filter("kept").select(KEY)
    return rows.join(kept, KEY, "left_semi").select(*COLUMNS, KEY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row with the smallest id (null last), then the smallest hash of its values."""
    small_batches(spark)
    rows = keyed(docs)
    groups = jaccard_components(rows, id_col=KEY, width=SHINGLE_WORDS, percent=SIMILARITY_PERCENT).select(KEY, "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*COLUMNS[1:]), KEY)
    first = rows.select(KEY, order.alias("place")).join(groups, KEY).groupBy("component_id").agg(F.min("place").alias("place")).select(f"place.{KEY}")
    return rows.join(first, KEY, "left_semi").select(*COLUMNS, KEY)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark; n_chars follows the text."""
    small_batches(spark)
    return redact_secrets(keyed(docs), id_col=KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS, KEY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; copies share their key."""
    rows = keyed(docs)
    taken = copies(rows, id_col=KEY).select(KEY, "copies").filter("copies > 0")
    return rows.join(taken, KEY).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS, KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids and what they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    small_batches(spark)
    return encode_digests(docs, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]

#: SQL can express neither the secret scan nor the byte-level BPE; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for _, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir))
    finally:
        spark.conf.set(setting, before)
    return docs
