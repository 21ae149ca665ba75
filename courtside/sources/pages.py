"""Pages of a results site to rows: a page's table rows by a table function, profiles and match histories as columns.

The site's pages are tables. One reader turns a page into its table rows, each a list of cells, each cell the list of its
stripped texts. What the cells mean, a profile's lines or a match's games, is said in columns.

Pages of plain markup (known tags, quoted attributes, no table in a table) are read by one pattern whose matches are whole
rows where these are simple; all other pages go through the parser. Both give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import text as tx

ROW = "table_id string, section string, row_no int, classes array<string>, cells array<array<string>>"
#: The table of a page of matches between two players, and the class of the rows that hold data.
MATCH_TABLE, DATA_ROW = "list_26_com_fabrik_26", "fabrik_row"
MATCH_CELLS, PROFILE_CELLS = 10, 6


class _Tables(HTMLParser):
    """Collects the table rows of a page, in the order in which they begin.

    A cell's text includes that of tables within it, whose cells also count as cells of the outer row. A row or a cell
    that isn't closed ends where the next one of its table begins, or with its table. Script and style have no text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.tables, self.silent, self.text = [], [], 0, []

    def flush(self) -> None:
        piece, self.text = "".join(self.text).strip(), []
        if piece:
            for table in self.tables:
                if table["cell"] is not None:
                    table["cell"].append(piece)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.tables.append({"id": dict(attrs).get("id"), "section": None, "row": None, "cell": None})
        elif self.tables:
            table = self.tables[-1]
            if tag in ("thead", "tbody", "tfoot"):
                table |= {"section": tag, "row": None, "cell": None}
            elif tag == "tr":
                table["row"], table["cell"] = [], None
                self.rows.append((table["id"], table["section"], len(self.rows), (dict(attrs).get("class") or "").split(), table["row"]))
            elif tag == "td":
                table["cell"] = []
                for outer in self.tables:
                    if outer["row"] is not None:
                        outer["row"].append(table["cell"])
            elif tag == "th":
                table["cell"] = None

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.tables:
            table = self.tables[-1]
            if tag == "table":
                self.tables.pop()
            elif tag in ("td", "th"):
                table["cell"] = None
            elif tag == "tr":
                table |= {"row": None, "cell": None}
            elif tag in ("thead", "tbody", "tfoot"):
                table |= {"section": None, "row": None, "cell": None}

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)


_INLINE = r"</?+(?:a|b|i|p|div|span)>|<br ?/?+>"
_CELL = rf"[^<]*+(?:(?:{_INLINE})[^<]*+)*+"
#: A whole row of simple cells, else one tag of plain markup. A match has one "<" per tag and no other.
_PLAIN = re.compile(
    rf"""<tr(?: class="([^"<>&]*+)")?+>((?:\s*+<td>{_CELL}</td>)++)\s*+</tr>|<(/?+)(table|thead|tbody|tfoot|tr|td|th|html|body|a|b|i|p|div|span)((?: [a-z]++="[^"<>&]*+")*+)>|<br ?/?+>"""
)
_CELLS, _INLINES, _ATTRIBUTE = re.compile(f"<td>({_CELL})</td>"), re.compile(_INLINE), re.compile(r' ([a-z]+)="([^"]*)"')


def _unescaped(text: str) -> str:
    if text.count("&") == text.count("&amp;") + text.count("&lt;") + text.count("&gt;"):
        return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
    return unescape(text)


def _pieces(cell: str) -> list[str]:
    if "<" in cell:
        return [piece for part in _INLINES.split(cell) for piece in _pieces(part)]
    piece = (_unescaped(cell) if "&" in cell else cell).strip()
    return [piece] if piece else []


def _cells(body: str, known: dict[str, list[str]]) -> list[list[str]]:
    """The texts of the simple cells of a whole row; equal cells of a page are taken apart once."""
    return [known[c] if c in known else known.setdefault(c, _pieces(c)) for c in _CELLS.findall(body)]


class Wanted(NamedTuple):
    """The table rows to read: of one table, in one section, with a class. None takes all."""

    table_id: str | None = None
    section: str | None = None
    kind: str | None = None

    def takes(self, table_id: str | None, section: str | None, classes: list[str]) -> bool:
        return self.table_id in (None, table_id) and self.section in (None, section) and (self.kind is None or self.kind in classes)


EVERY = Wanted()


def plain_table_rows(html: str, wanted: Wanted = EVERY) -> list[tuple] | None:
    """``table_rows`` of a page of plain markup; None for other pages."""
    rows, known, number, tags, end, inside, name, section, row, cell = [], {}, 0, 0, 0, False, None, None, None, None
    for found in _PLAIN.finditer(html):
        if cell is not None and found.start() > end:
            text = html[end : found.start()]
            if "<" in text:
                return None
            cell += _pieces(text)
        end = found.end()
        classes, body, closing, tag, attributes = found.groups()
        if body is not None:
            tags += body.count("<") + 2
            if inside:
                classes, row, cell = (classes or "").split(), None, None
                if wanted.takes(name, section, classes):
                    rows.append((name, section, number, classes, _cells(body, known)))
                number += 1
            continue
        tags += 1
        if tag == "table":
            if inside and not closing or closing and attributes:
                return None
            inside, name, section, row, cell = not closing, None, None, None, None
            if attributes:
                name = dict(_ATTRIBUTE.findall(attributes)).get("id")
        elif not inside or tag is None:
            continue
        elif tag in ("thead", "tbody", "tfoot"):
            section, row, cell = None if closing else tag, None, None
        elif tag == "tr":
            row, cell = None if closing else [], None
            if not closing:
                classes = ((dict(_ATTRIBUTE.findall(attributes)).get("class") if attributes else None) or "").split()
                if wanted.takes(name, section, classes):
                    rows.append((name, section, number, classes, row))
                number += 1
        elif tag == "td":
            cell = None if closing else []
            if row is not None and not closing:
                row.append(cell)
        elif tag == "th":
            cell = None
    if tags != html.count("<"):
        return None
    if cell is not None:
        cell += _pieces(html[end:])
    return rows


def parsed_table_rows(html: str) -> list[tuple]:
    """``table_rows`` of any page, by the parser."""
    reader = _Tables()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.rows


def table_rows(html: str | None, wanted: Wanted = EVERY) -> list[tuple]:
    """(table_id, section, row_no, classes, cells) of the wanted table rows of a page; none for null."""
    rows = plain_table_rows(html or "", wanted)
    return [r for r in parsed_table_rows(html) if wanted.takes(r[0], r[1], r[3])] if rows is None else rows


class TableRows:
    """The table function: one row per table row of a page."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from table_rows(html)


def _lists(ends: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _listed(pages: pa.Array, wanted: Wanted = EVERY) -> pa.Array:
    """The pages' table rows as Arrow lists. Only texts and places are kept page by page, so that no page's lists live on."""
    tables, sections, numbers, classes, texts = ([] for _ in range(5))
    of_page, of_classes, of_row, of_cell = [0], [0], [0], [0]
    for page in pages:
        for table_id, section, number, kinds, cells in table_rows(page.as_py(), wanted):
            tables.append(table_id)
            sections.append(section)
            numbers.append(number)
            classes += kinds
            of_classes.append(len(classes))
            for cell in cells:
                texts += cell
                of_cell.append(len(texts))
            of_row.append(len(of_cell) - 1)
        of_page.append(len(of_row) - 1)
    text = pa.string()
    rows = [pa.array(tables, text), pa.array(sections, text), pa.array(numbers, pa.int32()), _lists(of_classes, pa.array(classes, text)), _lists(of_row, _lists(of_cell, pa.array(texts, text)))]
    return _lists(of_page, pa.StructArray.from_arrays(rows, [c.split()[0] for c in ROW.split(", ")]))


def listed_rows(html: str, wanted: Wanted = EVERY) -> Column:
    """A page's wanted table rows as one array."""
    return F.arrow_udf(lambda pages: _listed(pages, wanted), f"array<struct<{ROW}>>")(F.col(html))


def with_table_rows(pages: DataFrame, html: str = "html", wanted: Wanted = EVERY) -> DataFrame:
    """Every page's wanted table rows beside the page's other columns; pages without any have none."""
    return pages.select(*(c for c in pages.columns if c != html), F.inline(listed_rows(html, wanted)))


def joined(cell: Column) -> Column:
    """A cell's texts, one after the other."""
    return F.array_join(cell, "")


def lines(cell: Column) -> Column:
    """A cell's texts by lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.array_join(cell, "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _last(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def _after(line: Column) -> Column:
    return F.trim(F.substring(line, F.locate(":", line) + 1, F.length(line)))


def key_values(found: Column) -> Column:
    """(key, value) pairs of lines: a line with a colon is a key up to it, the line after it its value; others are passed over.

    A value's line is never a key, whatever it holds. A key on the last line has an empty value.
    """
    pair = lambda key, value: F.array(F.struct(key.alias("key"), value.alias("value")))
    nothing = F.struct(F.lit(None).cast("string").alias("key"), F.array().cast("array<struct<key:string,value:string>>").alias("pairs"))

    def step(state: Column, line: Column) -> Column:
        taken = F.when(state["key"].isNotNull(), F.concat(state["pairs"], pair(state["key"], line))).otherwise(state["pairs"])
        key = F.when(state["key"].isNull() & F.contains(line, F.lit(":")), F.trim(F.split_part(line, F.lit(":"), F.lit(1))))
        return F.struct(key.alias("key"), taken.alias("pairs"))

    return F.aggregate(found, nothing, step, lambda s: F.when(s["key"].isNotNull(), F.concat(s["pairs"], pair(s["key"], F.lit("")))).otherwise(s["pairs"]))


def number_of(pairs: Column, *keys: str) -> Column:
    """The first word of a key's value as a number, of the first of ``keys`` that is there: 0 if it is empty or no key is there, null if it is no number."""
    of = lambda key: _last(F.transform(F.filter(pairs, lambda p: p["key"] == key), lambda p: p["value"]))
    value = F.trim(F.coalesce(*map(of, keys), F.lit("")))
    return F.when(value == "", 0).otherwise(F.split_part(value, F.lit(" "), F.lit(1)).try_cast("long"))


def profile_columns(cells: Column, as_of_year: int) -> dict[str, Column]:
    """player_id, name, assoc, gender, age, events, matches, wins, losses, titles of a profile's row.

    Gender is M unless it says Female; the age is the one given, else the years since birth, else null; the association is
    the last line of three capitals. Titles are the senior ones of the newer series, else all senior ones.
    """
    name, number = tx.name_and_id(joined(F.get(cells, F.lit(1))))
    about, career = lines(F.get(cells, F.lit(2))), key_values(lines(F.get(cells, F.lit(3))))
    said = lambda label: _last(F.transform(F.filter(about, lambda x: F.startswith(x, F.lit(label))), _after))
    digits = lambda x: F.when(F.regexp_like(x, F.lit(r"^\d+$")), x.try_cast("int"))
    given = _last(F.filter(F.transform(F.filter(about, lambda x: F.startswith(x, F.lit("Age:"))), lambda x: digits(_after(x))), lambda x: x.isNotNull()))
    capitals = F.filter(about, lambda x: (F.length(x) == 3) & (F.upper(x) == x) & (F.lower(x) != x))
    counts = {n: number_of(career, *keys) for n, keys in {"events": ["Events"], "matches": ["Matches"], "wins": ["Wins"], "losses": ["Loses"], "titles": ["WTT Senior Titles", "All Senior Titles"]}.items()}
    gender = F.when(F.contains(F.coalesce(said("Gender:"), F.lit("")), F.lit("Female")), "F").otherwise("M")
    return {"player_id": number, "name": F.trim(name), "assoc": F.coalesce(_last(capitals), F.lit("")), "gender": gender, "age": F.coalesce(given, as_of_year - digits(said("Birth Year:")))} | counts


def profiles(pages: DataFrame, as_of_year: int, html: str = "html") -> DataFrame:
    """The pages that hold a profile, with its fields: the page's first data row, if it has six cells or more."""
    rows = F.filter(listed_rows(html), lambda r: F.exists(r["classes"], lambda c: F.contains(c, F.lit(DATA_ROW))))
    first = pages.withColumn("v_cells", F.get(rows, F.lit(0))["cells"]).drop(html)
    return first.filter(F.size("v_cells") >= PROFILE_CELLS).withColumns(profile_columns(F.col("v_cells"), as_of_year)).drop("v_cells")


def match_columns(cells: Column, a: Column, b: Column) -> dict[str, Column]:
    """year, event, stage, subevent, round, games, result, winner, winner_id, best_of, match_scores, sets_a, sets_b of a match's row.

    The winner is A or B by name, else ?. Up to three games are a best of 3. Sets are those of "a - b", 0 without one, null
    if they are no numbers. Games are padded with N/A to five; more than five stay.
    """
    at = lambda i: joined(F.get(cells, F.lit(i)))
    names = ["year", "event", "stage", "subevent", "round"]
    games, result, winner = at(7), at(8), at(9)
    played = F.size(tx.games(games))
    sets = lambda i: F.when(F.contains(result, F.lit(" - ")), F.trim(F.split_part(result, F.lit(" - "), F.lit(i))).try_cast("int")).otherwise(0)
    return {n: at(i) for i, n in enumerate(names)} | {
        "games": games, "result": result, "winner": winner, "winner_id": F.when(winner == a, "A").when(winner == b, "B").otherwise("?"), "best_of": F.when(played <= 3, "Best of 3").otherwise("Best of 5"),
        "match_scores": tx.padded_games(games, F.greatest(F.lit(5), played)), "sets_a": sets(1), "sets_b": sets(2),
    }


def match_rows(pages: DataFrame, a: str, b: str, html: str = "html") -> DataFrame:
    """The matches of pages of two players named ``a`` and ``b``: one row per data row of ten cells in the body of the match table."""
    rows = with_table_rows(pages, html, Wanted(MATCH_TABLE, "tbody", DATA_ROW)).filter(F.size("cells") >= MATCH_CELLS)
    return rows.withColumns(match_columns(F.col("cells"), F.col(a), F.col(b))).drop("table_id", "section", "classes", "cells")


def history(matches: DataFrame, players: DataFrame, a: str, b: str) -> DataFrame:
    """Match rows with both players' profiles, in the columns of a history file; matches of players without a profile go."""
    side = lambda s: players.select(
        F.col("name").alias(f"Player {s}"), F.col("player_id").alias(f"ID_{s}"), *(F.col(c).alias(f"{c.title()}_{s}") for c in ("gender", "age", "events", "matches", "wins", "losses", "titles")),
    )
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    met = matches.join(side("A"), F.col(a) == F.col("Player A")).join(side("B"), F.col(b) == F.col("Player B"))
    game = lambda i: F.get("match_scores", F.lit(i - 1))
    scores = {f"Match_score{i}": F.when(game(i) == "N/A", "N/A").otherwise(quoted(game(i))) for i in range(1, 6)}
    sides = [f"{c}{s}" for s in "AB" for c in ("Player ", "ID_", "Gender_", "Age_", "Events_", "Matches_", "Wins_", "Losses_", "Titles_")]
    return met.select(
        F.col("year").alias("Year"), F.col("result").alias("Match Score"), *sides, F.col("winner").alias("Winner"), quoted(F.col("result")).alias("Score"),
        quoted(F.concat_ws("-", F.col("sets_a").cast("string"), F.col("sets_b").cast("string"))).alias("Head-To-Head"), F.col("best_of").alias("Best of 3/5"), *(c.alias(n) for n, c in scores.items()),
    )
