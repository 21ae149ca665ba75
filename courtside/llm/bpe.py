"""Byte-level BPE by overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised on its own row, in parallel. Where a chunk's
boundaries meet those of the chunk before it, both go on alike, since the pattern looks only forward: there the two are
stitched. The stitched pieces are then encoded, chunk by chunk, and their ids are joined in order. Decoding concatenates
the ids' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import table, text_of

#: Code points of a chunk, and by how many of the next chunk's it is longer.
CHUNK = 32_768
OVERLAP = 512
#: Pieces whose ids a worker keeps; then it starts anew.
CACHED_PIECES = 200_000


class _Pieces(dict):
    """Ids of a piece as little-endian bytes, by the piece's text."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        ids = b"".join(i.to_bytes(4, "little") for i in self.encode(piece.encode("utf-8")))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def codec(path: str, pattern: str):
    """(pattern, ids of a piece, bytes of an id) for a rank file, once per worker."""
    import regex
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(pattern), _Pieces(encoding._encode_single_piece), {rank.to_bytes(4, "little"): token for token, rank in ranks.items()}


def decode(ids: bytes, tokens: dict[bytes, bytes]) -> bytes:
    return b"".join(tokens[ids[i : i + 4]] for i in range(0, len(ids), 4))


def _whole(path: str, pattern: str):
    """Encode texts of one chunk: (b_row, b_id, b_text) to (b_row, b_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, _ = codec(path, pattern)
        for batch in batches:
            ids = [b"".join(map(pieces.__getitem__, split.findall(text))) for text in batch.column("b_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("b_row"), batch.column("b_id"), pa.array(ids, pa.binary())], ["b_row", "b_id", "ids"])

    return run


def _boundaries(pattern: str, chunk: int, overlap: int):
    """Adds to each chunk the ends of its pre-tokens, in code points of the whole text.

    The last pre-token of a window may go on beyond it, and the one before may depend on what follows; neither counts
    unless the window ends the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern)
        for batch in batches:
            cuts = []
            for text, start, last in zip(batch.column("b_text").to_pylist(), batch.column("b_start").to_pylist(), batch.column("b_last").to_pylist(), strict=True):
                ends = [m.end() for m in split.finditer(text)]
                cuts.append([start + e for e in (ends if last else ends[:-2])])
            heads = [[c for c in own if c <= start + overlap] for own, start in zip(cuts, batch.column("b_start").to_pylist(), strict=True)]
            tails = [[c for c in own if c > start + chunk] for own, start in zip(cuts, batch.column("b_start").to_pylist(), strict=True)]
            names = [*batch.schema.names, "b_cuts", "b_heads", "b_tails"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.list_(pa.int64())) for x in (cuts, heads, tails))], names)

    return run


def _stitched(path: str, pattern: str):
    """Encode the pieces of each stitched part; a part without a cut list is pre-tokenised again from its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, _ = codec(path, pattern)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, start = row["b_text"], row["b_start"]
                if row["b_cuts"] is None:
                    parts = split.findall(text)
                else:
                    marks = [row["b_from"], *(c for c in row["b_cuts"] if row["b_from"] < c <= row["b_to"])]
                    parts = [text[a - start : b - start] for a, b in zip(marks, marks[1:], strict=False)]
                out.append(b"".join(map(pieces.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("b_row", "b_id", "b_at")), pa.array(out, pa.binary())], ["b_row", "b_id", "b_at", "ids"])

    return run


def _digested(path: str, pattern: str, *, encoded: bool):
    """(b_id, ids) of encoded texts, or (b_id, b_text) of texts of one chunk, to (b_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, tokens = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            if encoded:
                all_ids = [x or b"" for x in batch.column("ids").to_pylist()]
            else:
                all_ids = [b"".join(map(pieces.__getitem__, split.findall(text))) for text in batch.column("b_text").to_pylist()]
            columns = [batch.column("b_id"), pa.array([len(x) // 4 for x in all_ids], pa.int64()), pa.array(map(sha, all_ids), pa.string()), pa.array((sha(decode(x, tokens)) for x in all_ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["b_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: id, ids (binary, unsigned 32-bit little-endian).

    Texts of at most ``chunk`` code points are one chunk. In longer ones, chunk k covers [k * chunk, (k + 1) * chunk +
    overlap). If two neighbours share no boundary in their overlap (a run without one, say), that text is encoded as one
    part. Null text counts as empty and has no ids. Repeated rows and null ids pass through, one result row each. An
    empty table gives an empty result. Other columns of the input are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    short, long = _rows(docs, id_col, text_col, chunk)
    short = short.mapInArrow(_whole(path, pattern), f"b_row long, b_id {kind}, ids binary").select("b_id", "ids")
    return short.unionByName(_long(long, kind, path, pattern, chunk, overlap)).withColumnRenamed("b_id", id_col)


def _rows(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """b_row, b_id, b_text of the texts of one chunk, and of the longer ones."""
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string"), text_of(text_col)).alias("b_row"), F.col(id_col).alias("b_id"), text_of(text_col).alias("b_text"))
    return rows.filter(F.length("b_text") <= chunk), rows.filter(F.length("b_text") > chunk)


def _long(long: DataFrame, kind: str, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """b_id, ids of texts of several chunks."""
    # Equal rows are told apart by a number of their own, which travels with all their chunks.
    long = long.withColumn("b_row", F.monotonically_increasing_id())
    count = F.greatest(F.ceil((F.length("b_text") - overlap) / chunk).cast("int"), F.lit(1))  # the last one alone reaches the end
    cut = long.withColumn("b_at", F.explode(F.sequence(F.lit(0), count - 1))).select(
        "b_row", "b_id", "b_at", (F.col("b_at") * chunk).cast("long").alias("b_start"), (F.length("b_text") <= (F.col("b_at") + 1) * chunk + overlap).alias("b_last"),
        F.substring("b_text", F.col("b_at") * chunk + 1, F.lit(chunk + overlap)).alias("b_text"),
    )
    base = f"b_row long, b_id {kind}, b_at int, b_start long, b_last boolean, b_text string"
    cut = cut.repartition("b_row", "b_at").mapInArrow(_boundaries(pattern, chunk, overlap), f"{base}, b_cuts array<long>, b_heads array<long>, b_tails array<long>")
    along, all_of = Window.partitionBy("b_row").orderBy("b_at"), Window.partitionBy("b_row")
    meets = F.array_min(F.array_intersect("b_heads", F.lag("b_tails").over(along)))
    cut = cut.withColumn("b_from", F.when(F.col("b_at") == 0, F.lit(0).cast("long")).otherwise(meets))
    cut = cut.withColumn("b_to", F.coalesce(F.lead("b_from").over(along), F.col("b_start") + F.length("b_text")))
    cut = cut.withColumn("b_whole", F.max(F.col("b_from").isNull()).over(all_of))
    good = cut.filter(~F.col("b_whole")).select("b_row", "b_id", "b_at", "b_start", "b_text", "b_cuts", "b_from", "b_to")
    again = cut.filter(F.col("b_whole")).withColumn("b_text", F.when(F.col("b_last"), F.col("b_text")).otherwise(F.substring("b_text", 1, chunk)))
    again = again.groupBy("b_row").agg(F.first("b_id").alias("b_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b_at", "b_text"))), lambda x: x["b_text"]), "").alias("b_text"))
    again = again.select("b_row", "b_id", F.lit(0).alias("b_at"), F.lit(0).cast("long").alias("b_start"), "b_text", *(F.lit(None).cast(t).alias(c) for c, t in (("b_cuts", "array<long>"), ("b_from", "long"), ("b_to", "long"))))
    parts = good.unionByName(again).mapInArrow(_stitched(path, pattern), f"b_row long, b_id {kind}, b_at int, ids binary")
    joined = parts.groupBy("b_row").agg(F.first("b_id").alias("b_id"), F.array_sort(F.collect_list(F.struct("b_at", "ids"))).alias("parts"))
    return joined.select("b_id", F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of encoded texts; null ids count as none."""
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("b_id"), "ids")
    return rows.mapInArrow(_digested(path, pattern, encoded=True), f"b_id {kind}, {_DIGESTS}").withColumnRenamed("b_id", id_col)


def encode_digests(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``digests`` of ``encode``, without sending the ids from one Python worker to a second one."""
    kind = docs.schema[id_col].dataType.simpleString()
    short, long = _rows(docs, id_col, text_col, chunk)
    out = short.select("b_id", "b_text").mapInArrow(_digested(path, pattern, encoded=False), f"b_id {kind}, {_DIGESTS}")
    long = _long(long, kind, path, pattern, chunk, overlap).mapInArrow(_digested(path, pattern, encoded=True), f"b_id {kind}, {_DIGESTS}")
    return out.unionByName(long).withColumnRenamed("b_id", id_col)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    return encode_digests(table(spark, sf_dir, "documents"), **how)
