"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

A pre-token begins as one symbol a byte. A heap holds the ranks of adjacent pairs, a linked list the symbols that are
left. The pair of the lowest rank is popped and merged, and the pairs with its new neighbours are pushed, until the heap
is empty. Each merge leaves one symbol fewer, so a pre-token counts its bytes minus its merges.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm.common import table, text_of

#: Pre-tokens whose counts a worker keeps, of at most so many code points; then it starts anew.
CACHED_PIECES, CACHED_LENGTH = 1_000_000, 64
#: Code points from which a text's pre-tokens are taken one by one, without a list of them all.
LISTED = 1_000_000
#: Tokens above which a text is over the limit.
LIMIT = 512


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible Latin-1 letters for themselves, others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges(dict):
    """Tokens of a pre-token, by its text. Reads a byte-level BPE vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (spec.get("normalizer"), spec.get("post_processor"), model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"))
        if model.get("type") != "BPE" or any(plain) or model.get("ignore_merges") or model.get("byte_fallback") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.width = max(ids.values()) + 1
        letters = byte_letters()
        self.letters = [ids[c] for c in sorted(letters, key=letters.get)]
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[left] * self.width + ids[right]] = rank * self.width + ids[left + right]
        added = spec.get("added_tokens") or []
        if any(a.get(flag) for a in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens with options")
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.names = names

    def __missing__(self, piece: str) -> int:
        count = self.count(piece.encode("utf-8"))
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = count
        return count

    def count(self, raw: bytes) -> int:
        n, width, find, pop, push = len(raw), self.width, self.pairs.get, heapq.heappop, heapq.heappush
        symbols = [self.letters[b] for b in raw]
        # a pair's entry is its rank, the merged symbol and its place in one number, so that the lowest rank is on top, leftmost first
        heap = [hit * n + i for i in range(n - 1) if (hit := find(symbols[i] * width + symbols[i + 1]))]
        if not heap:
            return n
        heapq.heapify(heap)
        # the last symbol's successor is n; a merged one is -1
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            top, i = divmod(pop(heap), n)
            own, j = symbols[i], after[i]
            if own < 0 or j == n or find(own * width + symbols[j]) != top:
                continue  # one of the two has been merged since
            merged, k, h = top % width, after[j], before[i]
            symbols[i], symbols[j], after[i] = merged, -1, k
            left -= 1
            if k < n:
                before[k] = i
                if hit := find(merged * width + symbols[k]):
                    push(heap, hit * n + i)
            if h >= 0 and (hit := find(symbols[h] * width + merged)):
                push(heap, hit * n + h)
        return left


@lru_cache(maxsize=2)
def counter(path: str, pattern: str):
    """A function from a text to its number of tokens, once per worker.

    Letters that one Unicode version has and another lacks are judged by the library's own pre-tokeniser.
    """
    import regex
    from tokenizers import pre_tokenizers

    merges, split = Merges(path), regex.compile(pattern)
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    letters = byte_letters()
    raw = lambda shown: bytes(letters[c] for c in shown)
    unassigned = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    newer = sorted(regex.findall(r"[\p{L}\p{N}]", unassigned))
    high = regex.compile(f"[{newer[0]}-\U0010ffff]") if newer else None
    newer = regex.compile(f"[{''.join(newer)}]") if newer else None

    def tokens(text: str) -> int:
        if not text:
            return 0
        if high and high.search(text) and newer.search(text):
            return sum(merges.count(raw(shown)) for shown, _ in library.pre_tokenize_str(text))
        pieces = split.findall(text) if len(text) <= LISTED else (m[0] for m in split.finditer(text))
        return sum(map(merges.__getitem__, pieces))

    def count(text: str) -> int:
        if merges.special is None or not any(name in text for name in merges.names):
            return tokens(text)
        parts = merges.special.split(text)
        return len(parts) - 1 + sum(map(tokens, parts))

    return count


def token_counts(docs: DataFrame, *, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a byte-level BPE vocabulary in the tokenizers library's JSON, ``pattern`` what its pre-tokeniser splits by.
    Special tokens' strings in a text count as one token each. Null text counts as empty and has no tokens. Repeated rows
    and null ids pass through, one result row each. An empty table gives an empty result. Other columns are not read.
    Each text is counted whole, in one task; nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            counts = pa.array((count(text.as_py()) for text in batch.column("k_text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k_id"), batch.column("n_bytes"), counts], ["k_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("k_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("k_text"))
    counted = rows.mapInArrow(run, f"k_id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("k_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)
