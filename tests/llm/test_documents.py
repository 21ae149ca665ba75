"""The operators on documents against brute force, and on awkward tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from courtside.llm import bpe, compaction, licenses, mixing, ngram_join, quality, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts(spark, awkward, nothing):
    texts = ["a b c a b c " * 30, "x\ny\nx\n \n", "p q r s t " * 20 + "#*$", "the of and " * 40, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    for r in quality.quality_rules(df).collect():
        t = texts[r.doc_id] or ""
        words = WORD.findall(t)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.base_failed, r.kept, r.class_distance) for r in quality.quality_rules(awkward).collect()), key=str)
    assert [x[:5] for x in got] == sorted([(1, 0, 0, True, False), (2, 0, 0, True, False), (3, 1, 3, True, False), (3, 1, 3, True, False), (None, 60, 240, True, False), (4, 18000, 54000, True, False), (5, 0, 0, True, False), (6, 50, 150, True, False)], key=str)
    assert all(x[5] is None for x in got)  # no document of any language passes the base rules
    assert quality.quality_rules(nothing).count() == 0


def test_quality_distances(spark):
    """Distances against a plain computation; below the minimum length they don't count."""
    normal = ["the cat of the hill and a dog in that house is on the way with it " * 1 + " ".join(f"word{i}" for i in range(90 + k)) for k in range(30)]
    odd = ["XQ!!9 " + " ".join(f"Q!{i}!7#" for i in range(100)), "XQ!!9 " + " ".join(f"Q!{i}!7#" for i in range(60))]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(normal + odd)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_rules(df, max_word_distance=1.0).collect()}

    def classes(t):
        kind = lambda c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 if c == " " else 4 if c in "#*$%&|<>" else 6 if ord(c) > 127 else 5
        n = Counter(map(kind, t))
        return [n[k] for k in range(7)]

    total = [sum(c) for c in zip(*map(classes, normal + odd), strict=True)]
    q = [x / sum(total) for x in total]
    for i, t in enumerate(normal + odd):
        p = [x / len(t) for x in classes(t)]
        half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
        assert got[i].class_distance == pytest.approx(math.sqrt((half(p, q) + half(q, p)) / 2), abs=1e-6)
    assert all(got[i].kept for i in range(30)) and not got[30].kept and got[31].kept  # 61 words are too few to compare


def test_secrets_against_plain_scan(spark):
    """Base spans against a scan by hand over random pieces."""
    r = random.Random(5)
    pieces = ["password", "Secret", "TOKEN", "api_key", "apikey", "passwd", "=", ":", " ", "  ", '"', "'", "AKIA", "A1B2C3", "Z" * 14, "0123456789abcdef", "ff", "x" * 11, "y" * 12, "\n", "é", "/", "-", "."]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(40))) for _ in range(400)]
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def runs(t, chars, least):
        out, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and t[j] in chars:
                j += 1
            if j - i >= least:
                out.append((i, j))
            i = max(j, i + 1)
        return out

    def assigned(t):
        out, i = [], 0
        while i < len(t):
            end = None
            for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
                if t[i : i + len(key)].lower() == key:
                    j = i + len(key) + (t[i + len(key) : i + len(key) + 1] in ('"', "'"))
                    while t[j : j + 1] == " ":
                        j += 1
                    if t[j : j + 1] in ("=", ":"):
                        j += 1
                        while t[j : j + 1] == " ":
                            j += 1
                        j += t[j : j + 1] in ('"', "'")
                        k = j
                        while k < len(t) and t[k] in value:
                            k += 1
                        if k > j:
                            end = k
                            if k - j >= 12:
                                out.append((i, k))
                    break
            i = end or i + 1
        return out

    def access(t):
        upper, out, i = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), [], 0
        while (i := t.find("AKIA", i)) >= 0:
            j = i + 4
            while j < len(t) and t[j] in upper:
                j += 1
            out += [(i, j)] if j - i >= 18 else []
            i = j
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in secret_scan.secret_spans(df, words=()).collect():
        t = texts[x.doc_id]
        spans = sorted([(a, 0, b) for a, b in assigned(t)] + [(a, 1, b) for a, b in access(t)] + [(a, 2, b) for a, b in runs(t, set("0123456789abcdef"), 16)])
        assert x.base_sha256 == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest(), t
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))


def test_novelty_rates(spark):
    """Near a sensitive word, random strings of every length are reported and compounds of the corpus' words are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = secret_scan.common_words(docs)
    assert 300 < len(words) <= secret_scan.SAMPLE_WORDS
    texts, r = [x.text for x in docs.filter("length(text) > 1500").orderBy("doc_id").limit(150).collect()], random.Random(3)

    def rate(make, times):
        found = 0
        for t in texts[:times]:
            at, planted = t.index(" ", r.randrange(1000)), make()
            found += (at + 8, 3, at + 8 + len(planted)) in secret_scan.novel_spans(f"{t[:at]} secret {planted}{t[at:]}", [], words=words)
        return found / times

    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = {"base64": upper + lower + digits + "+/", "base62": upper + lower + digits, "base32": upper + "234567", "hex": digits + "ABCDEF"}
    for length in (20, 32, 47, 48, 64, 100, 256, 512, 1024, 4096):
        rates = {kind: rate(lambda: "".join(r.choice(letters) for _ in range(length)), 100 if length < 500 else 40) for kind, letters in alphabets.items()}  # noqa: B023
        assert min(rates.values()) >= 0.95, (length, rates)
    for n in (4, 6, 12, 40):
        rates = {joint: rate(lambda: joint.join(r.choice(words) for _ in range(n)), 100) for joint in "-/_"}  # noqa: B023
        assert max(rates.values()) <= 0.05, (n, rates)


def test_secret_pieces():
    """Pieces cover a candidate from end to end, whatever its length."""
    for length in range(20, 400):
        cut = secret_scan.pieces(7, 7 + length)
        covered = {i for a, b in cut for i in range(a, b)}
        assert covered == set(range(7, 7 + length)) and (len(cut) == 1 or all(b - a == secret_scan.PIECE for a, b in cut))


def test_secret_context():
    """Only words outside a candidate make its surroundings sensitive, and only as words or parts of names."""
    r = random.Random(8)
    code = base64.b64encode(r.randbytes(33)).decode()
    near = lambda t: bool(secret_scan.novel_spans(t, []))
    assert all(near(t.format(code)) for t in ("my secret {}", "{} is the token", "API_KEYS: {}", "apiKey {}", "userToken={}", "x_auth={}"))
    assert not any(near(t.format(code)) for t in ("a monkey {}", "keyboard {}", "nothing {}", "turkey={}", "{} authority"))
    assert not near(f"see key/{code}") and not near("api docs at /usr/local/lib/python3.11/site-packages/requests/api.py") and not near("key layout: QWERTYUIOPASDFGHJKLZXCVBNM")


def test_secrets(spark, awkward, nothing):
    secret = "wJalrXUtnFEMIK7MDENGbPxRfiCYzzQ9k2Vw8Lp0"
    texts = {1: f"my api_key: {secret} end", 2: "token=short", 3: "AKIA" + "A1" * 8 + " x", 4: "0123456789abcdef0", 5: f"auth bearer {secret} ok", 6: f"plain {secret}", 7: "Token = 'abcdefghijkl'"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.secret_spans(df).collect()}
    assert [got[i].n_assign for i in (1, 2, 7)] == [1, 0, 1] and got[3].n_access == 1 and got[4].n_hex == 1
    assert got[5].n_novel == 1 and got[6].n_novel == 0 and got[2].spans == ""
    assert got[4].base_sha256 == hashlib.sha256(b"hex:0:17").hexdigest()
    clean = {r.doc_id: r.text for r in secret_scan.redact_secrets(df).collect()}
    assert clean[5] == "auth bearer [secret] ok" and clean[2] == "token=short"
    assert secret_scan.secret_spans(awkward).count() == awkward.count() and secret_scan.secret_spans(nothing).count() == 0
    assert secret_scan.redact_secrets(awkward).columns == awkward.columns


def test_mixing(spark, awkward, nothing):
    r = random.Random(2)
    sizes = {"a": [r.randrange(1, 60) for _ in range(150)], "b": [r.randrange(1, 60) for _ in range(40)], "c": [5, 5, 5], None: [7] * 20}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.copies(df).collect()))
    whole = {s: sum(ns) for s, ns in sizes.items()}
    weights, top, at_top = dict(zip(("a", "b", "c", None), (5, 2, 1, 5), strict=True)), {s: 3 * n for s, n in whole.items()}, set()
    while True:
        level = (sum(whole.values()) - sum(top[s] for s in at_top)) / sum(w for s, w in weights.items() if s not in at_top)
        target = {s: top[s] if s in at_top else level * weights[s] for s in whole}
        over = {s for s in whole if target[s] > top[s]}
        if not over:
            break
        at_top |= over
    for s in whole:
        mine = [g for g in got if g.m_key == ("" if s is None else f"={s}")]
        assert mine[0].target == pytest.approx(target[s]) and all(0 <= g.copies <= 3 for g in mine)
        assert abs(sum(g.copies * g["size"] for g in mine) - target[s]) <= max(sizes[s])
        low, high = -50.0, 50.0  # the dual's solution by bisection
        for _ in range(200):
            at = (low + high) / 2
            low, high = (at, high) if sum(n * min(3, math.exp(min(at * n, 700))) for n in sizes[s]) < target[s] else (low, at)
        for g in mine:
            assert g.rate == pytest.approx(3.0 if target[s] >= 3 * whole[s] else min(3, math.exp(at * g["size"])), rel=1e-4)
    grouped = mixing.copies(df, group_rows=20).collect()  # sources that are dealt to several groups
    for s in whole:
        assert abs(sum(g.copies * g["size"] for g in grouped if g.m_key == ("" if s is None else f"={s}")) - target[s]) <= 3 * max(sizes[s])
    assert mixing.copies(awkward).count() == awkward.count() and mixing.copies(nothing).count() == 0


def test_licenses(spark, awkward, nothing):
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0. cc by-nc, CC BY NC", "GNU General Public License, version 3", "nothing here", "SPDX-License-Identifier: MPL-2.0", "cc by nc sa license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].base_labels, got[0].labels) == (1, 1, "mit", "mit")
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 3, 11, "apache-2,cc-by-nc")
    assert got[4].labels == "mpl-2" and got[4].score == 1.0 and got[3].labels == "" and got[3].score == 0
    assert got[5].labels == "cc-by-nc,cc-by-nc-sa"
    assert licenses.license_scan(awkward).count() == awkward.count() and licenses.license_scan(nothing).count() == 0


def test_license_signatures(spark):
    """Each signature's own words, fused versions and lookalikes, against the rules run one by one."""
    import re

    words = lambda w: " ".join("some" if t == "*" else t.rstrip("?").split("|")[0] for t in w.split())
    texts = [words(w) for *_, w in licenses.SIGNATURES] + ["GPLv3+ license", "LGPLv2.1 license", "licensed under the Apache2", "an MIT-licensed tool", "released under AGPLv3", "the gplus license plate", "apache2go", "a mitigated licence"]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    rules = licenses.signature_rules()
    for i, text in enumerate(texts):
        bare = re.sub(licenses.SEPARATORS, "><", text.lower()).strip("<>")
        marked = f"<{bare}>"
        hits = sorted((m.start(), -m.end(), priority, rule, label, score) for rule, label, priority, score, pattern, _ in rules for m in re.finditer(pattern, marked))
        kept = [h for k, h in enumerate(hits) if all(-b[1] < -h[1] or b[2] > h[2] for b in hits[:k])]
        base = {label for phrase, label in licenses.PHRASES if licenses.marked(phrase) in marked}
        assert got[i] == (",".join(sorted({h[4] for h in kept} | base)), max((h[5] for h in kept), default=0.5 if base else 0.0)), text
    assert all(got[i][0] for i in range(len(licenses.SIGNATURES)))
    assert [got[len(licenses.SIGNATURES) + i][0] for i in range(8)] == ["gpl-3", "lgpl-2.1", "apache-2", "mit", "agpl-3", "", "", ""]


def test_bpe(spark, awkward, nothing):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import tiktoken

    how = {"path": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    with open(how["path"], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=how["pattern"], mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = ["", "a" * 900, "1" * 700, "    " * 200, "don't we're  ok\n\n x " * 60] + ["".join(r.choice(["a", "bc", " ", "  ", "\n", "'s", "'re", "12", "!!", "é", "漢", "x" * 30]) for _ in range(r.randrange(900))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.encode(df, **how, chunk=200, overlap=40)
    for x in got.collect():
        assert [int.from_bytes(x.ids[i : i + 4], "little") for i in range(0, len(x.ids), 4)] == plain.encode_ordinary(texts[x.doc_id])
    for x in bpe.digests(got, **how).collect():
        assert x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()
    assert sorted(bpe.digests(got, **how).collect()) == sorted(bpe.encode_digests(df, **how, chunk=200, overlap=40).collect())
    assert bpe.encode(awkward, **how, chunk=50, overlap=10).count() == awkward.count() and bpe.encode(nothing, **how).count() == 0


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(a), find(rows[j][0])))
                root[y] = x
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


@pytest.mark.parametrize("rare", [2, 16])
def test_ngram_join(spark, rare):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(2000)]
    passage = [r.choice(vocab) for _ in range(50)]
    rows = []
    for _ in range(14):
        base = [r.choice(vocab) for _ in range(r.choice([3, 8, 20, 60, 150]))] + (passage if r.random() < 0.4 else [])
        for _ in range(r.choice([1, 3, 30])):
            rows.append((2 * len(rows) + 1, " ".join(r.choice(vocab) if r.random() < 0.02 else w for w in base)))
    rows += [(9001, ""), (9003, None), (9005, "A b"), (9007, "a  B")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df, rare=rare).collect()}
    assert got == brute_components(rows, 4, 85)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_of_large_families(spark, width, percent):
    """Hundreds of near copies around centres that are themselves alike, edited near the limit, and shared passages."""
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    edited = lambda words, n: [r.choice(vocab) if i in at else w for i, w in enumerate(words)] if (at := set(r.sample(range(len(words)), n))) or True else words
    first, passage = [r.choice(vocab) for _ in range(140)], [r.choice(vocab) for _ in range(60)]
    centres = [first, edited(first, 4), edited(first, 6), [r.choice(vocab) for _ in range(40)]]
    rows = [(len(centres) * i + k, " ".join(edited(c, r.choice([0, 1, 1, 2, 3, 4, 5, 7, 10]))[: r.randrange(len(c) - 4, len(c) + 1)])) for k, c in enumerate(centres) for i in range(110)]
    rows += [(10_000 + i, " ".join([r.choice(vocab) for _ in range(r.choice([3, 8, 30, 60]))] + passage)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df, width=width, percent=percent, rare=4).collect()}
    want = brute_components(rows, width, percent)
    assert got == want and 20 < len({c for _, c in want.values()}) < 500


def test_ngram_join_ids(spark):
    """Ids of any type; rows of one id are judged by their own texts, rows without an id take part."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("b", text), (None, text + " more"), ("a", "quite another text of seven words"), ("a", text), (None, "alone with five words here"), (None, None), ("e", " ")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([("b", 37, "a"), (None, 38, "a"), ("a", 3, "a"), ("a", 37, "a"), (None, 2, None), (None, 0, None), ("e", 0, "e")], key=str)


def test_ngram_join_awkward(awkward, nothing):
    got = ngram_join.jaccard_components(awkward).collect()
    assert len(got) == awkward.count() and {x.component_id for x in got if x.doc_id == 3} == {3}
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_compaction(spark, awkward, nothing, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20)
    for _ in range(5):
        store.append(awkward.repartition(2))
    before = store.version()
    assert store.compact() > before and len(store.shards()) < len(store.shards(before))
    assert store.read().count() == store.read(before).count() == 5 * awkward.count()
    with pytest.raises(compaction.Conflict):
        store._commit(store.version(), awkward.schema.json(), [])
    with pytest.raises(ValueError, match="schema"):
        store.append(awkward.select("doc_id"))
    assert store.vacuum() > 0 and store.read().count() == 5 * awkward.count() and len(list(tmp_path.glob("store/shards/*/*.parquet"))) == len(store.shards())
    arrived = compaction.ShardStore(spark, f"file://{tmp_path}/arrived", target_bytes=4 << 20)
    rows = spark.range(2000).select("id", F.concat_ws(" ", *(F.xxhash64("id", F.lit(k)) for k in range(8))).alias("text")).coalesce(1)
    compaction.arrive(arrived, rows)
    tiers = [{arrived.tier(s["bytes"]) for s in arrived.shards(v)} for v in (1, 7)]
    assert arrived.version() == 7 and len(arrived.shards()) == 7 and len(tiers[1]) > 1
    assert arrived.compact() == 9 and [s["level"] for s in arrived.shards(8)].count(1) == 1 and [s["level"] for s in arrived.shards(9)] == [2]
    assert sorted(r.id for r in arrived.read().collect()) == list(range(2000)) == sorted(r.id for r in arrived.read(7).collect())
    other = compaction.ShardStore(spark, f"file://{tmp_path}/empty")
    other.append(nothing)
    assert other.read().count() == 0


def test_common_words_count_over_all_documents(spark):
    """A word of twelve texts among 8,000 is common, wherever they stand; one that only copies of a text have isn't."""
    texts = spark.range(8000).selectExpr("id AS doc_id", "concat('text number ', id, CASE WHEN id % 700 = 3 THEN ' zebrafish' ELSE '' END) AS text")
    copies = spark.range(8000, 8050).selectExpr("id AS doc_id", "'text with hunter' AS text")
    words = secret_scan.common_words(texts.unionByName(copies))
    assert set(words) == {"text", "number", "zebrafish"} and words[0] == "zebrafish"
