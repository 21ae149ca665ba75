"""Quality rules by distribution divergence, with DataFrame functions only.

Each text gets exact rule counts, a histogram of character classes and one of common words. Both histograms are
compared with the reference of the text's language by the Jensen-Shannon distance. The references are sums over all
documents of a language that the base rules keep, so junk doesn't shift them; they are one row per known language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm.common import stored, table, text_of, words_of

#: Frequent function words of the languages that have a word reference.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "auf"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
CLASSES = ["lower", "upper", "digit", "space", "symbol", "punct", "wide"]
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Distances are compared only from this many words on; short texts scatter too much.
MIN_DIVERGENCE_WORDS = 80
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.6


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(""))


def _per_language(lang: Column, make) -> Column:
    out = F.array(*[F.lit(0).cast("long")] * len(COMMON_WORDS["en"]))
    for name, words in COMMON_WORDS.items():
        out = F.when(lang == name, make(words)).otherwise(out)
    return out


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def histograms(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """q_id, q_lang, q_text, q_words, q_classes (counts by CLASSES), q_common (counts by common word, then the rest)."""
    base = docs.select(F.col(id_col).alias("q_id"), _language(F.coalesce(F.col(lang_col), F.lit(""))).alias("q_lang"), text_of(text_col).alias("q_text"))
    known = sorted({w for words in COMMON_WORDS.values() for w in words})
    # Most characters are lower-case letters and spaces; the classes are told apart in what is left of them.
    base = base.withColumns({"q_words": words_of(F.col("q_text")), "q_rest": F.regexp_replace("q_text", r"[a-z\x20\x09-\x0D]+", "")})
    rest = F.col("q_rest")
    base = base.withColumns(
        {
            "q_word_chars": F.length(F.array_join("q_words", "")).cast("long"),
            "q_upper": _without(rest, "[A-Z]+"),
            "q_digit": _without(rest, "[0-9]+"),
            "q_symbol": _without(rest, r"[#*$%&|<>]+"),
            "q_wide": _without(rest, r"[^\x00-\x7F]+"),
            "q_hits": F.filter("q_words", lambda w: w.isin(*known)),
        }
    )
    lower = F.col("q_word_chars") - F.length(rest)
    punct = F.length(rest) - F.col("q_upper") - F.col("q_digit") - F.col("q_symbol") - F.col("q_wide")
    classes = [lower, F.col("q_upper"), F.col("q_digit"), F.length("q_text") - F.col("q_word_chars"), F.col("q_symbol"), punct, F.col("q_wide")]
    count = lambda word: F.size(F.filter("q_hits", lambda h: h == word)).cast("long")
    counts = _per_language(F.col("q_lang"), lambda ws: F.array(*map(count, ws)))
    base = base.withColumns({"q_classes": F.array(*(c.cast("long") for c in classes)), "q_common": counts})
    others = F.size("q_words") - F.aggregate("q_common", F.lit(0).cast("long"), lambda s, x: s + x)
    base = base.withColumn("q_common", F.concat("q_common", F.array(others)))
    return base.select("q_id", "q_lang", "q_text", "q_words", "q_word_chars", "q_symbol", "q_classes", "q_common")


def references(hist: DataFrame) -> DataFrame:
    """One row per known language, and one for all others: summed histograms of all rows."""
    n, m = len(CLASSES), len(COMMON_WORDS["en"]) + 1
    sums = [F.sum(F.col("q_classes")[i]).alias(f"c{i}") for i in range(n)] + [F.sum(F.col("q_common")[i]).alias(f"w{i}") for i in range(m)]
    return hist.groupBy("q_lang").agg(*sums).select(F.col("q_lang").alias("r_lang"), F.array(*(f"c{i}" for i in range(n))).alias("r_classes"), F.array(*(f"w{i}" for i in range(m))).alias("r_common"))


def js_distance(left: Column, right: Column) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of two count arrays, 0 to 1; null if either sums to 0."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    share = lambda a, t: F.transform(a, lambda x: x / t)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    p, q = share(left, total(left)), share(right, total(right))
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    divergence = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when((total(left) > 0) & (total(right) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


#: A window's hash and its position share one long, so that sorting runs on plain longs; longer texts sort pairs.
POSITION_BITS = 20


def rule_counts(hist: DataFrame) -> DataFrame:
    """Adds n_words, n_dup_lines, n_repeat_words.

    A 3-word window is compared by a hash of its words. Only a text in which two windows share a 64-bit hash is looked
    at further: sorting (hash, position) puts equal windows side by side, so its work is n log n and stays in its row;
    neighbours count only if their words are equal. Where neighbours have equal leading bits of the hash but other words,
    and in texts of more than 2**20 windows, the order is that of (hash, words, position), which nothing can interleave.
    """
    words, mask = F.col("q_words"), (1 << POSITION_BITS) - 1
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = hist.withColumns({"n_words": F.size(words).cast("long"), "q_lines": lines})
    out = out.withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
    none = F.array().cast("array<bigint>")
    word = lambda i: F.get(words, i)
    windows = F.when(F.size(words) >= 4, F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)))).otherwise(none)
    out = out.withColumn("q_windows", windows)
    out = out.withColumn("q_repeats", F.size(F.array_distinct("q_windows")) < F.size("q_windows"))
    packed = F.sort_array(F.transform("q_windows", lambda h, i: h.bitwiseAND(~mask).bitwiseOR(i.cast("long"))))
    out = out.withColumn("q_packed", F.when(F.col("q_repeats") & (F.size("q_windows") <= mask + 1), F.transform(packed, lambda x: x.bitwiseAND(mask).cast("int"))))
    same = lambda i, j: (F.get("q_windows", i) == F.get("q_windows", j)) & (word(i) == word(j)) & (word(i + 1) == word(j + 1)) & (word(i + 2) == word(j + 2))
    lead = lambda i: F.get("q_windows", i).bitwiseAND(~mask)
    clash = lambda i, j: F.coalesce((lead(i) == lead(j)) & ~same(i, j), F.lit(False))
    clashes = F.exists(F.transform("q_packed", lambda i, k: clash(i, F.get("q_packed", k + 1))), lambda x: x)
    exact = F.transform(F.array_sort(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.alias("i")))), lambda x: x["i"])
    out = out.withColumn("q_order", F.when(F.col("q_packed").isNotNull() & ~clashes, F.col("q_packed")).when(F.col("q_repeats"), exact))
    place = lambda k: F.get("q_order", k)
    found = F.filter("q_order", lambda i, k: F.coalesce(same(i, place(k + 1)), F.lit(False)) | F.when(k > 0, same(i, place(k - 1))).otherwise(False))
    out = out.withColumn("q_found", found)
    covered = F.size(F.array_distinct(F.flatten(F.transform("q_found", lambda i: F.array(i, i + 1, i + 2)))))
    return out.withColumn("n_repeat_words", F.when(F.col("q_repeats"), covered).otherwise(0).cast("long"))


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_divergence_words: int = MIN_DIVERGENCE_WORDS, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of the words stand in repeated 3-word
    windows. kept: the base rules hold, and no distance is above its limit. Distances are held against their limits
    from ``min_divergence_words`` words on. Unknown and null languages share one reference and have no word distance.
    Without any document of a language that the base rules keep, its distances are null.

    Null or empty text: all counts 0, base_failed, not kept, null distances. Repeated rows and null ids pass through,
    one result row each. An empty table gives an empty result. Other columns of the input are not read.
    """
    counted = rule_counts(histograms(docs, id_col, text_col, lang_col))
    counted = stored(counted.select("q_id", "q_lang", "q_word_chars", "q_symbol", "q_classes", "q_common", "n_words", "n_dup_lines", "n_repeat_words"))  # numbers only; two readers
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    reference = references(counted.filter(~failed))  # at most one row per known language, and one more
    out = counted.join(F.broadcast(reference), F.col("q_lang") == F.col("r_lang"), "left")
    out = out.withColumns({"class_distance": js_distance(F.col("q_classes"), F.col("r_classes")), "word_distance": F.when(F.col("q_lang") != "", js_distance(F.col("q_common"), F.col("r_common")))})
    apart = (F.col("n_words") >= min_divergence_words) & ((F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance))
    return out.select(
        F.col("q_id").alias(id_col), "n_words", F.col("q_word_chars").alias("word_chars"), F.col("q_symbol").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~apart).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def oracle() -> str:
    lists = {k: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for k, ws in COMMON_WORDS.items()}
    common = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lists.items()) + " END"
    every = "[" + ", ".join(f"'{w}'" for w in sorted({w for ws in COMMON_WORDS.values() for w in ws})) + "]"
    n, m = len(CLASSES), len(COMMON_WORDS["en"]) + 1
    gone = lambda pattern: f"(length(rest) - length(regexp_replace(rest, '{pattern}', '', 'g')))"
    total = lambda x: f"list_sum({x})"
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"

    def distance(p: str, q: str, size: int) -> str:
        terms = " + ".join(f"({half(f'({p}[{i}] / {total(p)})', f'({q}[{i}] / {total(q)})')} + {half(f'({q}[{i}] / {total(q)})', f'({p}[{i}] / {total(p)})')}) / 2" for i in range(1, size + 1))
        return f"CASE WHEN {total(p)} > 0 AND {total(q)} > 0 THEN sqrt(greatest({terms}, 0)) END"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON_WORDS)}) THEN lang ELSE '' END AS lang FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, regexp_replace(text, '[a-z\x20\x09-\x0D]+', '', 'g') AS rest FROM d),
 x AS (SELECT *, length(list_aggregate(list_concat(words, ['']), 'string_agg', '')) AS word_chars, {gone("[A-Z]+")} AS up, {gone("[0-9]+")} AS digit, {gone("[#*$%&|<>]+")} AS symbol, {gone("[^\\x00-\\x7F]+")} AS wide,
   list_filter(words, lambda v: list_contains({every}, v)) AS hits, list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS lines FROM w),
 y AS (SELECT *, [word_chars - length(rest), up, digit, length(text) - word_chars, symbol, length(rest) - up - digit - symbol - wide, wide] AS classes,
   list_transform(coalesce({common}, ['', '', '', '', '', '', '', '', '', '', '', '']), lambda c: CASE WHEN c = '' THEN 0 ELSE len(list_filter(hits, lambda v: v = c)) END) AS c0 FROM x),
 z AS (SELECT *, list_concat(c0, [len(words) - list_sum(c0)]) AS common FROM y),
 tri AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
 dup AS (SELECT r, i FROM tri JOIN (SELECT r, g FROM tri GROUP BY r, g HAVING count(*) > 1) USING (r, g)),
 cov AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
 e AS (SELECT z.*, coalesce(cov.n, 0) AS n_repeat, len(words) < {MIN_WORDS} OR 100 * coalesce(cov.n, 0) > {MAX_REPEAT_PERCENT} * len(words) AS failed FROM z LEFT JOIN cov USING (r)),
 ref AS (SELECT lang, [{", ".join(f"sum(classes[{i}])" for i in range(1, n + 1))}] AS rc, [{", ".join(f"sum(common[{i}])" for i in range(1, m + 1))}] AS rw FROM e WHERE NOT failed GROUP BY lang),
 g AS (SELECT e.*, {distance("classes", "rc", n)} AS cd, CASE WHEN e.lang <> '' THEN {distance("common", "rw", m)} END AS wd FROM e LEFT JOIN ref USING (lang))
SELECT doc_id, len(words)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, symbol::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words,
 failed AS base_failed, NOT failed AND NOT (len(words) >= {MIN_DIVERGENCE_WORDS} AND (coalesce(cd, 0) > {MAX_CLASS_DISTANCE} OR coalesce(wd, 0) > {MAX_WORD_DISTANCE})) AS kept,
 round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM g"""
