"""Secret scans: exact patterns, and dictionary-primed zstandard novelty.

A candidate is a long token near a sensitive word. Its novelty is what it adds to the compressed size of the text around
it, with a compressor primed by a dictionary of identifiers and code, and of the words that most texts of the corpus
use. A token that the dictionary and its surroundings explain adds little; a random one adds more bytes than it has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm.common import table, text_of

KINDS = ["assign", "access", "hex", "novel"]
BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
}
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

#: Words that make their surroundings sensitive.
SENSITIVE = ["access", "api", "auth", "bearer", "credential", "key", "login", "passphrase", "passwd", "password", "private", "pwd", "secret", "signature", "token"]
#: Parts of identifiers and code that prime the compressor.
IDENTIFIERS = [
    "access", "account", "address", "app", "application", "array", "async", "authorization", "await", "aws", "base64", "bearer", "boolean", "buffer", "callback", "certificate", "class", "client",
    "com", "config", "connection", "const", "content", "context", "cookie", "create", "credential", "data", "database", "default", "delete", "description", "document", "encoding",
    "endpoint", "environment", "error", "example", "exception", "export", "false", "file", "filter", "format", "function", "handler", "header", "https://www.", "identifier", "import", "index",
    "instance", "integer", "interface", "json", "key", "length", "library", "localhost", "location", "manager", "message", "method", "module", "number", "object", "options", "package", "parameter",
    "password", "path", "private", "process", "property", "protected", "provider", "public", "query", "repository", "request", "resource", "response", "result", "return", "schema", "secret",
    "/etc/", "/home/", "/opt/", "/usr/bin/", "/usr/local/lib/", "/usr/share/", "/var/log/", "node_modules", "python3", "site-packages", "src", "test",
    "abcdefghijklm", "asdfghjkl", "nopqrstuvwxyz", "qwertyuiop", "zxcvbnm", "0123456789",
    "self", "server", "service", "session", "signature", "source", "static", "status", "string", "system", "template", "token", "true", "type", "undefined", "update", "user", "username", "value", "version", "void",
]

#: An equals sign only ends a candidate, as padding; elsewhere it stands between a name and a value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.~-]{20,}={0,2}", re.ASCII)
#: A candidate is measured in pieces of so many characters, a shorter one as a whole.
PIECE = 32
#: Code points on either side of a candidate: for a sensitive word, and for compression.
NEAR, AROUND = 48, (96, 128, 160, 192, 224, 256, 288, 320)
#: Added bytes per byte of the candidate from which it is reported. Measured in 120 documents: random base64, base62, base32
#: and upper-case hex of 20 to 4,096 characters are at or above it in 99 % at least; three to forty words of the corpus, joined
#: by hyphens, slashes or underscores, in 1 % at most, in camel case in 8 % (three words) to 1 % (forty).
NOVELTY = 0.85
#: The dictionary holds so many of the corpus' words.
SAMPLE_WORDS = 4_000
#: A word counts from so many different texts on, so that a secret which copies share doesn't prime its own search.
SAMPLE_TEXTS = 10


def common_words(docs: DataFrame, *, text_col: str = "text", most: int = SAMPLE_WORDS) -> tuple[str, ...]:
    """The words that most different texts of all documents use, rarest first, so that the common ones are nearest."""
    texts = docs.select(text_of(text_col).alias("text")).distinct()
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z][a-z]{2,23})\b"), 1))).alias("word"))
    top = words.groupBy("word").count().filter(F.col("count") >= SAMPLE_TEXTS).orderBy(F.desc("count"), "word").limit(most)
    return tuple(r["word"] for r in reversed(top.collect()))


@lru_cache(maxsize=2)
def _compressor(words: tuple[str, ...]):
    import zstandard

    content = " ".join([*words, *(f"{w} {w}_ {w.title()} {w.upper()}_" for w in IDENTIFIERS)])
    primed = zstandard.ZstdCompressionDict(content.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False)


def pieces(start: int, end: int, size: int = PIECE) -> list[tuple[int, int]]:
    """Pieces of one size that cover a candidate, evenly spaced; the whole if it is no longer."""
    length = end - start
    if length <= size:
        return [(start, end)]
    n = -(-length // size)
    return [(at, at + size) for at in (start + i * (length - size) // (n - 1) for i in range(n))]


def novelty(text: str, start: int, end: int, words: tuple[str, ...] = ()) -> float:
    """Marginal compressed bytes of text[start:end] among its surroundings, per byte of its own.

    Each piece of a candidate is measured as if it stood there alone, and the candidate has their mean: else the coder would
    learn a long random string's alphabet from its beginning, and find the rest cheap. One difference of two compressed
    sizes is off by a few bytes either way, as the surroundings' own coding changes with it; so it is the mean over
    surroundings of several widths.
    """
    compress, cut, added = _compressor(words).compress, [text[a:b].encode() for a, b in pieces(start, end)], 0.0
    for around in AROUND:
        before, after = text[max(0, start - around) : start].encode(), text[end : end + around].encode()
        plain = len(compress(before + after))
        added += sum((len(compress(before + own + after)) - plain) / len(own) for own in cut)
    return added / (len(cut) * len(AROUND))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, leftmost and without overlap within a kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in BASE["assign"].finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in BASE["access"].finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    return sorted(found + [(m.start(), 2, m.end()) for m in BASE["hex"].finditer(text)])


#: A sensitive word stands alone or as a part of a name: my_key, apiKey, TOKENS, but not monkey or keyboard.
_NEARBY = re.compile(rf"(?:(?<![A-Za-z])(?i:{'|'.join(SENSITIVE)})|(?<=[a-z])(?:{'|'.join(w.title() for w in SENSITIVE)}))(?:s|S)?(?![a-z])", re.ASCII)


def novel_spans(text: str, base: list[tuple[int, int, int]], threshold: float = NOVELTY, words: tuple[str, ...] = ()) -> list[tuple[int, int, int]]:
    """Candidates near a sensitive word that no base span touches and that the dictionary doesn't explain."""
    out, at, merged = [], 0, []
    for s, _, e in base:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(merged) and merged[at][1] <= start:
            at += 1
        touched = at < len(merged) and merged[at][0] < end
        if touched or not (_NEARBY.search(text[max(0, start - NEAR) : start]) or _NEARBY.search(text[end : end + NEAR])):
            continue
        if len(set(text[start:end])) >= 8 and novelty(text, start, end, words) >= threshold:
            out.append((start, 3, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _spans_of(text: str, threshold: float, words: tuple[str, ...]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, threshold, words))


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = NOVELTY, words: tuple[str, ...] | None = None) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    spans lists kind:start:end of all spans by start, then kind; code points, end exclusive. base_sha256 is the SHA-256
    of that list without the method's own kind, ``novel``. Null text counts as empty: no spans. Repeated rows and null
    ids pass through, one result row each. An empty table gives an empty result. Other columns are not read. ``words``
    prime the compressor; they are fitted on the documents themselves if not given.
    """
    words = common_words(docs, text_col=text_col) if words is None else words
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_spans_of(text, threshold, words) for text in batch.column("s_text").to_pylist()]
            counts = [[sum(k == n for _, k, _ in every) for _, every in rows] for n in range(4)]
            columns = [
                batch.column("s_id"), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array((hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows), pa.string()),
                pa.array((joined(every) for _, every in rows), pa.string()), pa.array(counts[3], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["s_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    rows = docs.select(F.col(id_col).alias("s_id"), text_of(text_col).alias("s_text"))
    return rows.mapInArrow(run, f"s_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long").withColumnRenamed("s_id", id_col)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", threshold: float = NOVELTY, words: tuple[str, ...] | None = None,
) -> DataFrame:
    """The input with all spans of secret_spans in its text replaced by ``mark``; rows and other columns stay.

    A null text stays null. An empty table stays empty.
    """
    words = common_words(docs, text_col=text_col) if words is None else words

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: None if t is None else redacted(t, _spans_of(t, threshold, words)[1], mark))

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
