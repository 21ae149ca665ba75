"""Token counts against the tokenizers library."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from courtside.llm import token_counts

HOW = {"path": public_tokenizers.path("byte_bpe_50k.json"), "pattern": public_tokenizers.PATTERN}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(HOW["path"])


def tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(library):
    """Pieces that matter to the pre-tokeniser, any code points, special tokens within texts, and long runs."""
    count, r = token_counts.counter(**HOW), random.Random(1)
    pieces = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "'s", "'LL", "'ve", "the", " Then", "123", "²", "ⅷ", "é", "漢字", "😀", "՘", "\U0001df30", "\U000323b0", "!!", "_", "ab" * 40]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(30))) for _ in range(600)]
    anything = lambda: chr(r.choice([r.randrange(0x250), r.randrange(0x250, 0xD800), r.randrange(0xE000, 0x34000)]))
    texts += ["".join(anything() for _ in range(r.randrange(30))) for _ in range(600)] + ["ab" * 60_000, "a" * 99_999, " " * 5000 + "x", "\n" * 3000, "é漢" * 9000]
    assert [count(t) for t in texts] == [tokens(library, t) for t in texts]


def test_code_points_split_as_in_the_library(library):
    count = token_counts.counter(**HOW)
    for first in [*range(0, 0x3400, 64), *range(0xA000, 0xAC00, 64), *range(0xF900, 0x20000, 64), *range(0x2A000, 0x34000, 512)]:
        text = "".join(f"a{chr(c)}b {chr(c)}1 " for c in range(first, first + 64) if not 0xD800 <= c < 0xE000)
        assert count(text) == tokens(library, text), hex(first)


def test_long_texts_need_no_list(library, monkeypatch):
    token_counts.counter.cache_clear()
    monkeypatch.setattr(token_counts, "LISTED", 10)
    text = "Some words, and 42 more of them!\n" * 50
    assert token_counts.counter(**HOW)(text) == tokens(library, text)
    token_counts.counter.cache_clear()


def test_table(spark, awkward, nothing, library):
    got = sorted((tuple(r) for r in token_counts.token_counts(awkward, **HOW).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), tokens(library, r.text), tokens(library, r.text) > 512) for r in awkward.collect()]
    assert got == sorted(want, key=str) and any(x[3] for x in got)
    empty = token_counts.token_counts(nothing, **HOW)
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and empty.count() == 0


def test_query(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d.doc_id: (len((d.text or "").encode()), n := tokens(library, d.text), n > 512) for d in docs}


def test_other_vocabularies_are_refused(tmp_path):
    with open(HOW["path"], encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["ignore_merges"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.Merges(str(other))
