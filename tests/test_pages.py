"""Hand-made pages of a results site: profiles, matches, and their odd cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from courtside.functions import text as tx
from courtside.sources import files
from courtside.sources import pages as pg


def row(*cells, kind="fabrik_row"):
    return f'<tr class="{kind}">' + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def profile(spark, *cells, kind="fabrik_row oddrow", year=2026):
    pages = spark.createDataFrame([(1, f"<table><tr><th>x</th></tr>{row(*cells, kind=kind)}</table>")], "page_id long, html string")
    return [r.asDict() for r in pg.profiles(pages, year).collect()]


def test_table_rows():
    html = """<table id="a"><thead><tr><th>no cell</th></tr></thead><tbody class="z"><tr class="x y"><td> one <b>two</b><!-- three --> four &amp; </td><td></td></tr>
    <tr><td>outer<table id="in"><tr class="k"><td>inner</td></tr></table> after</td><td><script>var t = "</td>";</script>kept</td></tr></tbody></table><p>no table</p><table><tr><td>open<td>next<tr><td>last"""
    assert pg.table_rows(html) == [
        ("a", "thead", 0, [], []), ("a", "tbody", 1, ["x", "y"], [["one", "two", "four &"], []]), ("a", "tbody", 2, [], [["outer", "inner", "after"], ["inner"], ["kept"]]),
        ("in", None, 3, ["k"], [["inner"]]), (None, None, 4, [], [["open"], ["next"]]), (None, None, 5, [], [["last"]]),
    ]
    assert pg.table_rows(None) == pg.table_rows("") == pg.table_rows("plain </td></tr></table> text") == []


PLAIN = [
    "<table>", '<table id="a" class="q z">', '<table class="x" id="x" id="y">', "</table>", "<thead>", '<tbody class="k">', "</tbody>", "<tr>", '<tr class="a b">', '<tr id="3" class="c">', "</tr>", "<td>", "</td>", '<td class="m">', "<th>", "</th>",
    "text", "  ", "a &amp; b", "&amp;lt;", "&nbsp;", "&lt", "x&copy y", "<b>", "</b>", "<br>", "<br/>", "<i>", "</i>", '<a href="/p?x">', "</a>", "\n", "<tr><td>1</td> <td> 2<b>3</b> </td></tr>", '<tr class="fabrik_row"><td>&lt;z&gt;</td>\n<td></td></tr>', "</br>", " > ",
]
ODD = ["<!-- c -->", "<script>", "</script>", "<", "<td/>", "<TD>", "<tr class=x>", '<table id="a&amp;b">', "<title>", "</td >", "<style>", "<x-y>", "&#65;", "<b/>", "</>", "<?x>"]


def test_plain_pages_are_read_without_the_parser_and_alike():
    r, plain, wanted = random.Random(3), 0, pg.Wanted("a", "tbody", "c")
    for k in range(4000):
        html = "<table>" * (k % 2) + "".join(r.choice(PLAIN if k % 4 or r.random() < 0.9 else ODD) for _ in range(r.randrange(1, 25)))
        rows, said = pg.plain_table_rows(html), pg.parsed_table_rows(html)
        plain += rows is not None
        assert rows in (None, said), html
        assert pg.table_rows(html, wanted) == [x for x in said if x[0] == "a" and x[1] == "tbody" and "c" in x[3]], html
    assert plain > 1000
    page = f'<html><table id="m"><tbody>{row(2024, "Cup &lt;1&gt;", "Main <i>draw</i>", "A &amp; B")}</tbody></table></html>'
    assert pg.plain_table_rows(page) == pg.parsed_table_rows(page) == [("m", "tbody", 0, ["fabrik_row"], [["2024"], ["Cup <1>"], ["Main", "draw"], ["A & B"]])]


def test_table_function(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>"), (2, "none"), (3, None)], "page_id long, html string")
    got = sorted((r.page_id, r.row_no, r.cells) for r in pg.with_table_rows(pages).collect())
    assert got == [(1, 0, [["a"]]), (1, 1, [["b"]])]
    spark.udtf.register("table_rows", F.udtf(pg.TableRows, returnType=pg.ROW))
    pages.createOrReplaceTempView("the_pages")
    assert spark.sql("SELECT page_id, r.row_no FROM the_pages, LATERAL table_rows(html) r").count() == 2


def test_profile(spark):
    career = "<b>Events:</b><br>12<br>Matches:<br>340 (all)<br><b>Wins:</b> <br>200<br>Loses:<br>140<br>WTT Senior Titles:<br>7<br>All Senior Titles:<br>9"
    about = "<b>CHN</b><br>Gender: Female<br>Age: 24<br>Birth Year: 1990"
    assert profile(spark, 1, "<a>Xu Xin</a><i>(#111111)</i> rest", about, career, "", "") == [
        {"page_id": 1, "player_id": 111111, "name": "Xu Xin", "assoc": "CHN", "gender": "F", "age": 24, "events": 12, "matches": 340, "wins": 200, "losses": 140, "titles": 7}
    ]
    # no id, age from the birth year, titles of the older series, a value that is no number, a key as value, a key at the end
    other = profile(spark, 1, "No Id", "Gender: Male<br>Age: ?<br>Birth Year: 2000<br>ger", "All Senior Titles:<br>3<br>Matches:<br>many<br>Loses:<br>Wins:<br>5<br>text<br>Events:", "", "", year=2026)[0]
    assert other == {"page_id": 1, "player_id": None, "name": "No Id", "assoc": "", "gender": "M", "age": 26, "events": 0, "matches": None, "wins": 0, "losses": None, "titles": 3}
    assert profile(spark, 1, "A (#1)", "Age: 1x<br>Birth Year: c. 1990", "", "", "")[0]["age"] is None
    assert profile(spark, 1, "A (#1)", "", "", "") == [] and profile(spark, *"123456", kind="other") == []


def test_matches(spark):
    full = row(2024, "Cup", "Main <b>Draw</b>", "MS", "R16", "Ann Lee", "Bo Ek", "11:9, 9:11, 11:3, 11:4", "3 - 1", " Ann Lee ")
    html = (
        f'<table id="list_1"><tbody>{full}</tbody></table><table id="{pg.MATCH_TABLE}"><thead>{full}</thead><tbody>{full}{row(*range(9))}{row(*range(10), kind="sums")}'
        + row(2023, "Open", "Q", "MS", "R1", "x", "y", "", "WO", "Bo Ek") + row(2022, "", "", "", "", "", "", "1:2 " * 7, "a - b", "nobody") + "</tbody></table>"
    )
    pages = spark.createDataFrame([("h2h_01_Ann_Lee_vs_Bo_Ek.html", html), ("notes.html", html), ("h2h_02_C_vs_D_vs_E.html", None)], "file string, html string")
    a, b = tx.page_players(F.col("file"))
    pages = pages.withColumns({"a": a, "b": b})
    assert [(r.a, r.b) for r in pages.orderBy("file").collect()] == [("Ann Lee", "Bo Ek"), ("C vs D", "E"), (None, None)]
    got = [r.asDict() for r in pg.match_rows(pages.filter("a is not null"), "a", "b").orderBy(F.desc("year")).collect()]
    assert [(g["year"], g["stage"], g["winner_id"], g["best_of"], g["sets_a"], g["sets_b"], g["match_scores"]) for g in got] == [
        ("2024", "MainDraw", "A", "Best of 5", 3, 1, ["11-9", "9-11", "11-3", "11-4", "N/A"]), ("2023", "Q", "B", "Best of 3", 0, 0, ["N/A"] * 5), ("2022", "", "?", "Best of 5", None, None, ["1-2"] * 7),
    ]
    assert pg.match_rows(pages.filter("a is null"), "a", "b").filter("winner_id <> '?'").count() == 0


def test_history_file(spark, tmp_path):
    """Matches with both profiles go to a history file that the reader knows."""
    matches = spark.createDataFrame([("Ann", "Bo", 2024, "3 - 1", "Ann", "Best of 5", ["11-9", "N/A", "N/A", "N/A", "N/A"], 3, 1), ("Ann", "Cy", 2023, "0 - 3", "Cy", "Best of 3", ["N/A"] * 5, 0, 3)],
        "a string, b string, year long, result string, winner string, best_of string, match_scores array<string>, sets_a int, sets_b int")
    players = spark.createDataFrame([(1, "Ann", "F", 20, 1, 2, 3, 4, 5), (2, "Bo", "M", None, 1, 2, 3, 4, 5)], "player_id long, name string, gender string, age int, events long, matches long, wins long, losses long, titles long")
    out = pg.history(matches, players, "a", "b")
    assert len(out.columns) == 29 and out.count() == 1
    files.write_csv(out, f"{tmp_path}/history")
    back = files.read_history(spark, f"{tmp_path}/history").first()
    assert (back.a, back.b, back.ID_B, back.Age_B, back.best_of, back.Match_score2, back.Winner) == ("Ann", "Bo", "2", None, "Best of 5", "N/A", "Ann")
