"""Joins, pairings, orderings and rating features on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.functions import text as tx
from courtside.operators import joins as jn
from courtside.operators import ranking as rk
from courtside.operators import ratings as rt
from courtside.plans.inputs import MH, history, table
from courtside.shared import stored

r6 = lambda c, n: F.round(c, 6).alias(n)


def pair_join(spark: SparkSession, d: str) -> DataFrame:
    return jn.pair_join(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels"), ["doc_id"])


def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return jn.unpaired(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).groupBy("lang").agg(F.count("*").alias("unlabelled"))


def left_default(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return jn.left_default(docs, table(spark, d, "labels"), ["doc_id"], {"quality": -1, "toxic": 0})


def profile_join(spark: SparkSession, d: str) -> DataFrame:
    profiles = table(spark, d, "supplier").filter("s_suppkey % 10 <> 0").select("s_suppkey", "s_name", "s_nationkey")
    out = jn.profile_join(history(spark, d).select("l_orderkey", "l_linenumber", "a", "b"), profiles, "a", "b", "s_suppkey", ["s_name", "s_nationkey"])
    return out.select("l_orderkey", "l_linenumber", "s_name_a", "s_name_b", (F.col("s_nationkey_a") == F.col("s_nationkey_b")).alias("same_nation"))


def name_search(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name holds one of the names' own beginnings, in capitals, wherever it stands."""
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return jn.name_search(parts, "p_name", parts.select(F.upper(F.substring("p_name", 1, 3)).alias("wanted")).distinct(), "wanted").select("p_partkey", "wanted")


def union_sources(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("nation"))
    two = table(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("title"))
    return jn.union_sources({"cust": one, "supp": two}, "name")


def sort_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


def rank_slice(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    bucket = -F.floor(F.col("o_totalprice") / 5000)
    return rk.rank_slice(o, bucket, [F.desc("o_totalprice"), F.asc("o_orderkey")], 101, 200).select("o_orderkey", "o_totalprice", "rank")


def pair_enum(spark: SparkSession, d: str) -> DataFrame:
    return jn.pair_enumeration(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey")


def latest_row(spark: SparkSession, d: str) -> DataFrame:
    """Each player's last match on either side."""
    return rt.player_latest(history(spark, d), "a", "b", F.struct("day", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber", "score"])


LATEST = f"""WITH {MH}, p AS (SELECT a AS player, 'A' AS side, * FROM mh UNION ALL SELECT b AS player, 'B' AS side, * FROM mh)
SELECT player, r.side AS side, r.l_orderkey AS l_orderkey, r.l_linenumber AS l_linenumber, r.score AS score FROM (SELECT player, arg_max({{'side': side, 'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'score': score}}, {{'d': day, 'o': l_orderkey, 'n': l_linenumber}}) AS r FROM p GROUP BY player)"""


def career_diff(spark: SparkSession, d: str) -> DataFrame:
    """Differences of the two sides' careers: matches, wins, win rate, mean score."""
    m = history(spark, d)
    careers = rt.careers(m, "a", "b", "a_won", "score")
    pairs = m.select("a", "b").distinct()
    both = jn.profile_join(pairs, careers, "a", "b", "player", ["matches", "wins", "mean_score"])
    return both.select("a", "b", *rt.differences({"matches": "matches", "wins": "wins"}), r6((F.col("wins_a") / (F.col("matches_a") + 1e-6)) - (F.col("wins_b") / (F.col("matches_b") + 1e-6)), "win_rate_diff"), r6(F.col("mean_score_a") - F.col("mean_score_b"), "mean_score_diff"))


CAREER = f"""WITH {MH}, p AS (SELECT a AS player, a_won AS won, score FROM mh UNION ALL SELECT b, 1 - a_won, score FROM mh), c AS (SELECT player, count(*) AS matches, sum(won)::BIGINT AS wins, avg(score) AS mean_score FROM p GROUP BY player),
 q AS (SELECT DISTINCT a, b FROM mh) SELECT q.a, q.b, x.matches - y.matches AS matches_diff, x.wins - y.wins AS wins_diff, round(x.wins / (x.matches + 1e-6::DOUBLE) - y.wins / (y.matches + 1e-6::DOUBLE), 6) AS win_rate_diff, round(x.mean_score - y.mean_score, 6) AS mean_score_diff
FROM q JOIN c x ON x.player = q.a JOIN c y ON y.player = q.b"""


def prior_rate(spark: SparkSession, d: str) -> DataFrame:
    """Each match with both sides' share of wins before it, A less B; one half before the first match."""
    m = history(spark, d).select("l_orderkey", "l_linenumber", "day", "a", "b", "a_won")
    out = rt.prior_win_rates(m, "a", "b", "a_won", ["day", "l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.round("prior_a", 9).alias("prior_a"), F.round("prior_b", 9).alias("prior_b"), F.round(F.col("prior_a") - F.col("prior_b"), 9).alias("prior_diff"))


#: Both sides of a match lie next to each other in one list, so that the history is read once and nothing is joined.
PRIOR = f"""WITH {MH}, p AS (SELECT day, l_orderkey, l_linenumber, unnest([{{'player': a, 'side': 'A', 'won': a_won}}, {{'player': b, 'side': 'B', 'won': 1 - a_won}}]) AS s FROM mh),
 r AS (SELECT l_orderkey, l_linenumber, s.side AS side, coalesce(avg(s.won) OVER (PARTITION BY s.player ORDER BY day, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5) AS prior FROM p),
 w AS (SELECT l_orderkey, l_linenumber, max(prior) FILTER (side = 'A') AS prior_a, max(prior) FILTER (side = 'B') AS prior_b FROM r GROUP BY l_orderkey, l_linenumber)
SELECT l_orderkey, l_linenumber, round(prior_a, 9) AS prior_a, round(prior_b, 9) AS prior_b, round(prior_a - prior_b, 9) AS prior_diff FROM w"""


def pair_h2h(spark: SparkSession, d: str) -> DataFrame:
    """Head to head of each unordered pair: matches, the smaller id's wins and share, and who won last."""
    return rt.head_to_head(history(spark, d), "a", "b", "a_won", F.struct("day", "l_orderkey", "l_linenumber"))


H2H = f"""WITH {MH}, p AS (SELECT least(a, b) AS low, greatest(a, b) AS high, CASE WHEN a_won = 1 THEN a ELSE b END AS winner, day, l_orderkey, l_linenumber FROM mh)
SELECT low, high, count(*) AS matches, count(*) FILTER (winner = low) AS low_wins, round(count(*) FILTER (winner = low) / count(*), 6) AS low_rate, arg_max(winner, {{'d': day, 'o': l_orderkey, 'n': l_linenumber}}) AS last_winner FROM p GROUP BY low, high"""


def forecast(spark: SparkSession, d: str) -> DataFrame:
    """The forecast of each pair that has met, from its head to head."""
    h = pair_h2h(spark, d).withColumns({"a": F.concat(F.lit("Player "), "low"), "b": F.concat(F.lit("Player "), "high")})
    recent = F.concat(F.lit("Most recent winner: Player "), "last_winner")
    chance = F.floor(F.col("low_rate") * 1000) / 1000
    return h.select("low", "high", tx.forecast(F.col("a"), F.col("b"), chance, F.col("matches"), F.col("low_wins"), F.col("matches") - F.col("low_wins"), recent).alias("forecast"))


FORECAST = f"""WITH h AS ({H2H}), f AS (SELECT *, 'Player ' || low AS a, 'Player ' || high AS b, round(floor(low_rate * 1000) / 10, 1)::DOUBLE AS pa FROM h)
SELECT low, high, printf('%-22s %5.1f%% chance to win', a, pa) || chr(10) || printf('%-22s %5.1f%% chance to win', b, round(100 - pa, 1)) || chr(10) || printf('Head-to-Head (%d matches): %s %d – %d %s', matches, a, low_wins, matches - low_wins, b) || chr(10) || 'Most recent winner: Player ' || last_winner AS forecast FROM f"""


def onehot(spark: SparkSession, d: str) -> DataFrame:
    m = history(spark, d).withColumn("kind", F.concat_ws("_vs_", "l_returnflag", "l_linestatus"))
    return rt.one_hot(m, "kind", ["A_vs_F", "A_vs_O", "N_vs_F", "N_vs_O", "R_vs_F", "R_vs_O"], "kind_").select("l_orderkey", "l_linenumber", "kind_A_vs_O", "kind_N_vs_F", "kind_N_vs_O", "kind_R_vs_F", "kind_R_vs_O")


def onehot_found(spark: SparkSession, d: str) -> DataFrame:
    """The same columns from the values that the data have."""
    m = history(spark, d).withColumn("kind", F.concat_ws("_vs_", "l_returnflag", "l_linestatus"))
    out = rt.one_hot(m, "kind", None, "kind_")
    return out.select("l_orderkey", "l_linenumber", *(c for c in out.columns if c.startswith("kind_")))


def player_search(spark: SparkSession, d: str) -> DataFrame:
    """Players whose name holds the end of a part's name or a number, with what their last match says of them."""
    names = table(spark, d, "supplier").select("s_suppkey", F.col("s_name"))
    of = lambda s: names.select(F.col("s_suppkey").alias(s), F.col("s_name").alias(f"name_{s}"))
    m = history(spark, d).join(of("a"), "a").join(of("b"), "b").withColumns({"key_a": F.col("a"), "key_b": F.col("b"), "units_a": F.col("score"), "units_b": -F.col("score")})
    texts = names.select(F.substring("s_name", -3, 3).alias("wanted")).unionByName(table(spark, d, "part").select(F.substring("p_name", 1, 4).alias("wanted")))
    return jn.player_search(m, texts, "wanted", {"a": "name_a", "b": "name_b"}, F.struct("day", "l_orderkey", "l_linenumber"), ["key", "units"])


SEARCH = f"""WITH {MH}, w AS (SELECT DISTINCT lower(right(s_name, 3)) AS wanted FROM supplier UNION SELECT DISTINCT lower(substr(p_name, 1, 4)) FROM part),
 p AS (SELECT x.s_suppkey AS key, x.s_name AS name, 'a' AS side, score AS units, day, l_orderkey, l_linenumber FROM mh JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b
  UNION ALL SELECT y.s_suppkey, y.s_name, 'b', -score, day, l_orderkey, l_linenumber FROM mh JOIN supplier x ON x.s_suppkey = a JOIN supplier y ON y.s_suppkey = b),
 f AS (SELECT wanted, p.* FROM w JOIN (SELECT DISTINCT name FROM p) n ON contains(lower(n.name), wanted) JOIN p USING (name)),
 r AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, side) AS k FROM f)
SELECT wanted, side, name, key, units FROM r WHERE k = 1"""


def mask_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Images and masks of a game by frame number, which one side pads with zeros and the other doesn't."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("game"), "o_orderkey", "o_orderstatus")
    images = o.filter("o_orderstatus <> 'P'").select("game", F.format_string("img_%08d.jpg", "o_orderkey").alias("name"))
    masks = o.filter("o_orderstatus <> 'O'").select("game", F.concat(F.lit("mask2_frame"), "o_orderkey", F.lit(".png")).alias("name"))
    return jn.frame_pairs(images, masks, "game", "name").select("game", "frame", "name", "name_right", "pair")


def feature_align(spark: SparkSession, d: str) -> DataFrame:
    m = history(spark, d).select("l_orderkey", "l_linenumber", F.when(F.col("a_won") == 1, F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"))
    return rt.aligned(m, ["l_orderkey", "l_linenumber"], ["tax", "elo_diff", "discount"])


def pairing_features(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows of hypothetical pairings, all suppliers of a nation: career differences and head to head, one half if none."""
    m = history(spark, d)
    careers = rt.careers(m, "a", "b", "a_won", "score").select(F.col("player").alias("s_suppkey"), "matches", "wins")
    members = stored(table(spark, d, "supplier").select("s_nationkey", "s_suppkey").join(careers, "s_suppkey"))
    met = pair_h2h(spark, d).select("low", "high", F.col("low_rate").alias("h2h_rate"))
    both = jn.pairs_with_known(members, ["s_nationkey"], "s_suppkey", ["matches", "wins"], met, "low", "high", "h2h_rate", 0.5)
    both = both.select(F.col("s_suppkey_a").alias("a"), F.col("s_suppkey_b").alias("b"), *rt.differences({"matches": "matches", "wins": "wins"}), "h2h_rate")
    return rt.aligned(both, ["a", "b"], ["matches_diff", "wins_diff", "h2h_rate", "margin", "recent_winner"])


PAIRING = f"""WITH {MH}, p AS (SELECT a AS player, a_won AS won FROM mh UNION ALL SELECT b, 1 - a_won FROM mh), c AS (SELECT player, count(*) AS matches, sum(won) AS wins FROM p GROUP BY player),
 h AS (SELECT least(a, b) AS low, greatest(a, b) AS high, round(count(*) FILTER (CASE WHEN a_won = 1 THEN a ELSE b END = least(a, b)) / count(*), 6) AS rate FROM mh GROUP BY ALL),
 q AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey)
SELECT q.a, q.b, (x.matches - y.matches)::DOUBLE AS matches_diff, (x.wins - y.wins)::DOUBLE AS wins_diff, coalesce(h.rate, 0.5)::DOUBLE AS h2h_rate, 0.0::DOUBLE AS margin, 0.0::DOUBLE AS recent_winner
FROM q JOIN c x ON x.player = q.a JOIN c y ON y.player = q.b LEFT JOIN h ON h.low = q.a AND h.high = q.b"""


QUERIES = {f.__name__: f for f in (pair_join, anti_join, left_default, profile_join, name_search, union_sources, sort_limit, rank_slice, pair_enum, latest_row, career_diff, prior_rate, pair_h2h, forecast, onehot, onehot_found, player_search, mask_pairs, feature_align, pairing_features)}
ORACLES = {
    "pair_join": "SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "anti_join": "SELECT lang, count(*) AS unlabelled FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY lang",
    "left_default": "SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "profile_join": f"WITH {MH}, s AS (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) SELECT l_orderkey, l_linenumber, x.s_name AS s_name_a, y.s_name AS s_name_b, x.s_nationkey = y.s_nationkey AS same_nation FROM mh JOIN s x ON x.s_suppkey = a JOIN s y ON y.s_suppkey = b",
    "name_search": "WITH w AS (SELECT DISTINCT lower(substr(p_name, 1, 3)) AS wanted FROM part) SELECT p_partkey, wanted FROM part JOIN w ON contains(lower(p_name), wanted)",
    "union_sources": "SELECT 'cust_' || c_custkey AS name, c_nationkey AS nation, NULL AS title, 'cust' AS origin FROM customer UNION ALL SELECT 'supp_' || s_suppkey, s_nationkey, s_name, 'supp' FROM supplier",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "rank_slice": "SELECT * FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank BETWEEN 101 AND 300",
    "pair_enum": "SELECT x.s_nationkey, x.s_suppkey AS s_suppkey_a, y.s_suppkey AS s_suppkey_b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey",
    "latest_row": LATEST,
    "career_diff": CAREER,
    "prior_rate": PRIOR,
    "pair_h2h": H2H,
    "forecast": FORECAST,
    "pairing_features": PAIRING,
    "onehot": f"WITH {MH}, k AS (SELECT *, l_returnflag || '_vs_' || l_linestatus AS kind FROM mh) SELECT l_orderkey, l_linenumber, " + ", ".join(f"(kind = '{k}')::INTEGER AS kind_{k}" for k in ("A_vs_O", "N_vs_F", "N_vs_O", "R_vs_F", "R_vs_O")) + " FROM k",
    "feature_align": f"WITH {MH} SELECT l_orderkey, l_linenumber, coalesce(l_tax, 0) AS tax, 0.0::DOUBLE AS elo_diff, CASE WHEN a_won = 1 THEN l_discount ELSE 0 END AS discount FROM mh",
}
ORACLES |= {
    "onehot_found": ORACLES["onehot"],
    "player_search": SEARCH,
    "mask_pairs": "SELECT o_custkey % 50 AS game, o_orderkey AS frame, printf('img_%08d.jpg', o_orderkey) AS name, 'mask2_frame' || o_orderkey || '.png' AS name_right, (o_custkey % 50) || '_' || o_orderkey AS pair FROM orders WHERE o_orderstatus NOT IN ('P', 'O')",
}
