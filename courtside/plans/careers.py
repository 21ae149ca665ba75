"""Results pages to histories: pages that Spark makes of suppliers and of the match history, read back as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions import text as tx
from courtside.plans.inputs import MH, history, table
from courtside.shipping import ship
from courtside.sources import pages as pg

YEAR = 2026


def profile_pages(spark: SparkSession, d: str) -> DataFrame:
    """url, html of a profile for every supplier but each seventh, whose page has no data row."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    key = F.col("s_suppkey")
    counts = history(spark, d).groupBy(F.col("a").alias("s_suppkey")).agg(F.count("*").alias("played"), F.sum("a_won").alias("won"))
    s = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(counts, "s_suppkey", "left").fillna(0, ["played", "won"])
    age = F.when(key % 3 == 0, F.concat(F.lit("Birth Year: "), 1980 + key % 25)).when(key % 3 == 1, F.concat(F.lit("Age: "), 18 + key % 20)).otherwise("Age: unknown")
    titles = F.when(key % 5 == 0, "All Senior Titles").otherwise("WTT Senior Titles")
    text = F.concat_ws(
        "", F.lit('<html><body><table id="menu"><tr><td>Menu</td></tr></table><table><tr><th>Name</th></tr><tr class="oddRow0 fabrik_row"><td>1</td><td> <a href="/p">'), F.replace("s_name", F.lit("#"), F.lit(" &amp; ")),
        F.lit("</a><!-- id --><i>(#"), key, F.lit(")</i> since 2001</td><td><b>"), F.upper(F.substring("n_name", 1, 3)), F.lit("</b><br>Gender: "), F.when(key % 2 == 0, "Female").otherwise("Male"), F.lit("<br/>"), age,
        F.lit("</td><td><b>Events:</b>"), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("<br>"), key % 90, F.lit(" in all"))), F.lit("<br>Matches:<br>"), "played", F.lit("<b>Wins:</b><br>"), "won", F.lit("<br>Loses:<br>"),
        F.col("played") - F.col("won"), F.lit("<br>note<br>"), titles, F.lit(": of all<br>"), key % 11, F.lit("</td><td>"), F.lit("</td><td></td></tr></table></body></html>"),
    )
    return s.select(F.concat(F.lit("profile_"), key, F.lit(".html")).alias("url"), F.when(key % 7 == 0, '<table><tr class="fabrik_row"><td>x</td></tr></table>').otherwise(text).alias("html"))


def profile_fields(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return pg.profiles(profile_pages(spark, d), YEAR)


#: An empty Events value makes the line after it, which is the next key, the value: no number, and Matches is not found.
PROFILES = f"""{MH}, c AS (SELECT a, count(*) AS played, sum(a_won)::BIGINT AS won FROM mh GROUP BY a),
 profiles AS (SELECT 'profile_' || s_suppkey || '.html' AS url, s_suppkey::BIGINT AS player_id, replace(s_name, '#', ' & ') AS name, upper(substr(n_name, 1, 3)) AS assoc, CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  CASE s_suppkey % 3 WHEN 0 THEN {YEAR} - (1980 + s_suppkey % 25) WHEN 1 THEN 18 + s_suppkey % 20 END::INTEGER AS age, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 90 END::BIGINT AS events,
  CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE coalesce(played, 0) END::BIGINT AS matches, coalesce(won, 0)::BIGINT AS wins, (coalesce(played, 0) - coalesce(won, 0))::BIGINT AS losses, (s_suppkey % 11)::BIGINT AS titles
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN c ON a = s_suppkey WHERE s_suppkey % 7 <> 0)"""


def match_pages(spark: SparkSession, d: str) -> DataFrame:
    """file, html of the matches of every pair of the history."""
    h, s = history(spark, d), table(spark, d, "supplier")
    names = s.select("s_suppkey", F.replace("s_name", F.lit("#"), F.lit(" & ")).alias("name"))
    of = lambda x: names.select(F.col("s_suppkey").alias(x), F.col("name").alias(f"{x}_name"))
    h = h.join(of("a"), "a").join(of("b"), "b")
    order, units = F.col("l_orderkey"), F.col("score").cast("int")
    games = F.array_join(F.transform(F.sequence(F.lit(1), units % 7 + 1), lambda i: F.concat(F.lit("11:"), (units + i) % 10)), " ")
    winner = F.when(F.col("l_returnflag") == "A", F.col("a_name")).when(F.col("l_returnflag") == "R", F.col("b_name")).otherwise("retired")
    result = F.when(order % 5 == 0, "walkover").otherwise(F.concat(units % 4, F.lit(" - "), order % 4))
    safe = lambda c: F.replace(c, F.lit("&"), F.lit("&amp;"))
    cells = [F.year("day"), F.concat(F.lit("Cup &lt;"), order, F.lit("&gt;")), F.lit("Main <i>draw</i>"), F.lit("MS"), F.concat(F.lit("R"), F.col("l_linenumber")), safe("a_name"), safe("b_name"), games, result, safe(winner)]
    row = F.concat(F.lit('<tr class="fabrik_row"><td>'), F.concat_ws("</td>\n<td> ", *cells), F.lit("</td></tr>"))
    pages = h.groupBy("a", "b", "a_name", "b_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "l_orderkey", "l_linenumber", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    around = F.concat(
        F.lit('<html><table id="other"><tbody><tr class="fabrik_row">' + "<td>x</td>" * 10 + f'</tr></tbody></table><table class="list" id="{pg.MATCH_TABLE}"><thead><tr class="fabrik_row">' + "<td>head</td>" * 10 + "</tr></thead><tbody>"),
        "rows", F.lit('<tr class="fabrik_row"><td>too few</td></tr><tr class="sums">' + "<td>1</td>" * 10 + "</tr></tbody></table></html>"),
    )
    under = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    file = F.concat(F.lit("h2h_"), F.col("a") * 1000 + F.col("b"), F.lit("_"), under("a_name"), F.lit("_vs_"), under("b_name"), F.lit(".html"))
    return pages.select(file.alias("file"), around.alias("html"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    a, b = tx.page_players(F.col("file"))
    return pg.match_rows(match_pages(spark, d).withColumns({"a": a, "b": b}), "a", "b")


def h2h_matches(spark: SparkSession, d: str) -> DataFrame:
    m = _matches(spark, d).withColumn("match_scores", F.array_join("match_scores", ","))
    return m.select("a", "b", "year", "event", "stage", "subevent", "round", "games", "result", "winner", "winner_id", "best_of", "match_scores", "sets_a", "sets_b")


H2H = f"""{MH}, n AS (SELECT s_suppkey, replace(s_name, '#', ' & ') AS name FROM supplier),
 g AS (SELECT na.name AS a, nb.name AS b, mh.*, list_transform(range(1, score::INTEGER % 7 + 2), lambda i: '11:' || ((score::INTEGER + i) % 10)) AS gs FROM mh JOIN n na ON na.s_suppkey = mh.a JOIN n nb ON nb.s_suppkey = mh.b),
 h2h AS (SELECT a, b, year(day)::VARCHAR AS year, 'Cup <' || l_orderkey || '>' AS event, 'Maindraw' AS stage, 'MS' AS subevent, 'R' || l_linenumber AS round, array_to_string(gs, ' ') AS games,
  CASE WHEN l_orderkey % 5 = 0 THEN 'walkover' ELSE (score::INTEGER % 4) || ' - ' || (l_orderkey % 4) END AS result, CASE l_returnflag WHEN 'A' THEN a WHEN 'R' THEN b ELSE 'retired' END AS winner,
  CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE '?' END AS winner_id, CASE WHEN len(gs) <= 3 THEN 'Best of 3' ELSE 'Best of 5' END AS best_of,
  replace(array_to_string(list_concat(gs, list_transform(range(greatest(0, 5 - len(gs))), lambda i: 'N/A')), ','), ':', '-') AS match_scores,
  CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE score::INTEGER % 4 END AS sets_a, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE (l_orderkey % 4)::INTEGER END AS sets_b FROM g)"""


def h2h_history(spark: SparkSession, d: str) -> DataFrame:
    """Matches of two players with a profile, in the columns of a history file."""
    players = pg.profiles(profile_pages(spark, d), YEAR)
    return pg.history(_matches(spark, d), players, "a", "b")


def _history_sql() -> str:
    side = lambda p, s: f'{p}.name AS "Player {s}", {p}.player_id AS "ID_{s}", {p}.gender AS "Gender_{s}", {p}.age AS "Age_{s}", {p}.events AS "Events_{s}", {p}.matches AS "Matches_{s}", {p}.wins AS "Wins_{s}", {p}.losses AS "Losses_{s}", {p}.titles AS "Titles_{s}"'
    games = ", ".join(f"""CASE WHEN m.gs[{i}] = 'N/A' THEN 'N/A' ELSE '"' || m.gs[{i}] || '"' END AS "Match_score{i}\"""" for i in range(1, 6))
    return f"""WITH {PROFILES}, {H2H.removeprefix(MH + ", ")}, m AS (SELECT *, string_split(match_scores, ',') AS gs FROM h2h)
SELECT m.year AS "Year", m.result AS "Match Score", {side("pa", "A")}, {side("pb", "B")}, m.winner AS "Winner", '"' || m.result || '"' AS "Score", '"' || m.sets_a || '-' || m.sets_b || '"' AS "Head-To-Head", m.best_of AS "Best of 3/5", {games}
FROM m JOIN profiles pa ON pa.name = m.a JOIN profiles pb ON pb.name = m.b"""


QUERIES = {f.__name__: f for f in (profile_fields, h2h_matches, h2h_history)}
ORACLES = {
    "profile_fields": f"WITH {PROFILES} SELECT * FROM profiles",
    "h2h_matches": f"WITH {H2H} SELECT * FROM h2h",
    "h2h_history": _history_sql(),
}
