"""Ranked lexical search against a plain computation of every score."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from courtside.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """docs: (id, text) rows, items likewise; (item, rank, id, score) of every item's k best."""
    bags = [(i, Counter(own), len(own)) for i, t in docs if (own := terms(t))]
    count, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in bags:
            m = 50 + 50 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if t in bag)
            scores += [(-score, i is None, i or 0, i)] if score else []
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def test_terms():
    for text in ["The CAT-42's hut_é漢\x00Ünd\x7fx ÀB  z", "", "É", "a\x80b", "İK ſ"]:
        assert [t.decode() for t in search.terms_of(text)] == terms(text)


@pytest.mark.parametrize("seed", range(4))
def test_best_documents(spark, monkeypatch, seed):
    """Common and rare words, repeated texts and ids, many shards, ties at the k-th score, items in several blocks."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    text = lambda n: " ".join(words[min(int(r.expovariate(0.06)), 119)] for _ in range(n))
    same = text(9)
    docs = [(r.randrange(300) or None, r.choice([text(r.randrange(1, 40)), same, "", None])) for _ in range(500)]
    items = [(r.randrange(6) or None, text(r.randrange(1, 12)).upper()) for _ in range(12)] + [(7, None), (8, "nothing of this"), (9, same)]
    monkeypatch.setattr(search, "SHARD_DOCUMENTS", 40)
    tables = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for k, block in ((5, search.BLOCK_TERMS), (50, 30), (1000, 500)):
        assert got(search.lexical_search(*tables, k=k, block_terms=block)) == plain(docs, items, k)


def test_accumulators_are_limited():
    """The rare term's documents reach what the common one can't: no accumulator begins at it, and scores stay exact."""
    rare, common = (np.array([3, 5, 8]), np.array([900, 910, 920])), (np.arange(10), np.arange(10) + 100)
    for floor, k, kept in ((1, 3, [3, 5, 8]), (500, 9, [3, 5, 8]), (1, 4, list(range(10)))):
        found, scores = search.accumulate([rare, common], 10, k, floor)
        assert found.tolist() == kept
        assert dict(zip(found.tolist(), scores.tolist(), strict=True)) == {d: 100 + d + {3: 900, 5: 910, 8: 920}.get(d, 0) for d in kept}
    found, _ = search.accumulate([(np.array([1]), np.array([50])), (np.array([0, 1]), np.array([50, 1]))], 2, 1, 50)
    assert found.tolist() == [0, 1]  # a tie with the k-th score is no reason to stop


def test_awkward_tables(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "the cat, and WORD"), (None, "one"), (1, "one"), (3, None), (4, ""), (5, "漢")], "item_id long, text string")
    docs, asked = [(d.doc_id, d.text) for d in awkward.collect()], [(i.item_id, i.text) for i in items.collect()]
    assert got(search.lexical_search(awkward, items.withColumnsRenamed({}))) == plain(docs, asked, 50)
    assert got(search.lexical_search(nothing, items)) == got(search.lexical_search(awkward, items.limit(0))) == []
    assert got(search.lexical_search(awkward.filter("text is null or doc_id = 5"), items)) == []
