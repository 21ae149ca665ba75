"""The pipeline's stages on tables whose ids are null or repeat."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from courtside.llm.common import stored


@pytest.fixture(scope="module")
def documents(spark):
    """100 documents with ids of their own, and the same ones with a third of the ids null and a third equal."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(100)
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    docs = stored(docs)
    return docs, stored(docs.withColumn("doc_id", F.when(third == 0, None).when(third == 1, F.lit(5).cast("long")).otherwise(F.col("doc_id"))))


def test_rows_are_judged_by_their_own_texts(spark, documents):
    plain, shared = (pipeline.quality(spark, d, "") for d in documents)
    texts = lambda df: Counter(r.text for r in df.collect())
    assert texts(plain) and texts(plain) == texts(shared)
    first, second = (stored(pipeline.near_duplicates(spark, stored(x), "")) for x in (plain, shared))
    assert first.count() == second.count() > 0
    assert second.filter("doc_id is null").count() > 1 and second.filter("doc_id = 5").count() > 1


def test_first_of_near_duplicates(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text), (9, text), (4, text + " more"), (4, "another text with quite other words in it"), (None, "a third one which is not like them at all")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicates(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows[2:])
    assert len({r.row_key for r in got}) == 3


def test_run(spark, tmp_path):
    """All stages over a table with nulls, junk, copies, secrets and another column, against plain Python."""
    import base64
    import hashlib

    tiktoken, public_tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    good = lambda k: "the cat of the hill and a dog in that house is on the way with it " + " ".join(f"w{k}x{i}" for i in range(100))
    texts = {i: good(i) for i in range(30)} | {30: good(3), 31: good(4) + " more", 32: "too short", 33: None, 34: "", 35: "a b c " * 100, 36: good(36) + " password = abcdefghijklmnop"}
    rows = [(None if i == 29 else i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 1, "x") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    at, seen = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        at = stored(stage(spark, at, ""))
        seen.append(at.collect())
        if name != "tokens":
            assert at.columns[:5] == pipeline.COLUMNS
    assert Counter(r.text for r in seen[0]) == Counter(t for i, t in texts.items() if i not in (32, 33, 34, 35))
    kept = Counter(t for i, t in texts.items() if i not in (30, 31, 32, 33, 34, 35))
    assert Counter(r.text for r in seen[1]) == kept
    clean = {t: t.replace("password = abcdefghijklmnop", "[secret]") for t in kept}
    assert Counter(r.text for r in seen[2]) == Counter(clean.values()) and all(r.n_chars == len(r.text) for r in seen[2])
    assert {r.text for r in seen[3]} <= set(clean.values()) and max(Counter(r.text for r in seen[3]).values()) <= 3
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, len(plain.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in seen[3])
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in seen[4]) == want
    assert Counter(map(str, pipeline.run(spark, f"file://{tmp_path}").collect())) == Counter(map(str, seen[4]))
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
