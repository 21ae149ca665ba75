"""Text parsing as column expressions: scores, names, labels, winners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def winner_target(winner: Column, a: Column, b: Column) -> Column:
    """0 if A's name stands in the winner's text, 1 if B's does, else null; case ignored."""
    text = F.lower(winner)
    return F.when(F.contains(text, F.lower(a)), 0).when(F.contains(text, F.lower(b)), 1)


def margin(score: Column) -> Column:
    """a - b of a score "a-b"; 0 if it isn't one."""
    part = lambda i: F.trim(F.split_part(score, F.lit("-"), F.lit(i))).try_cast("int")
    return F.coalesce(F.when(F.size(F.split(score, "-")) == 2, part(1) - part(2)), F.lit(0))


def best_of(text: Column) -> Column:
    """3 if the text holds a 3, else 5."""
    return F.when(F.contains(text, F.lit("3")), 3).otherwise(5)


def win_share(text: Column) -> Column:
    """w / (w + l) of "w:l" or "w-l", else the text as a number, else one half."""
    parts = F.split(text, "[:-]")
    side = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    return F.coalesce(F.when(F.size(parts) == 2, F.try_divide(side(0), side(0) + side(1))), F.trim(text).try_cast("double"), F.lit(0.5))


def games(text: Column) -> Column:
    """The games "n:m" of a text as "n-m"."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+:\d+"), F.lit(0)), lambda g: F.replace(g, F.lit(":"), F.lit("-")))


def padded_games(text: Column, most: Column | int = 5) -> Column:
    """The first ``most`` games of a text, padded with N/A."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.slice(F.concat(games(text), F.array_repeat(F.lit("N/A"), most)), F.lit(1), most)


def frame_number(name: Column) -> Column:
    """The first number in a file name, without leading zeros."""
    return F.regexp_extract(name, r"(\d+)", 1).try_cast("long")


#: Fixed value: a name, and an id in brackets after it; whatever follows the brackets doesn't count.
NAME_AND_ID = r"^(.+?)\s*\(#(\d+)\)"


def name_and_id(text: Column) -> tuple[Column, Column]:
    """Name and id of "name (#id) ..."; the whole text and null otherwise."""
    found = F.regexp_extract(text, NAME_AND_ID, 1)
    return F.when(found != "", F.trim(found)).otherwise(text), F.regexp_extract(text, NAME_AND_ID, 2).try_cast("long")


def page_players(name: Column) -> tuple[Column, Column]:
    """The two players of a page of matches "h2h_<n>_<a>_vs_<b>.html", blanks for underscores; null for other names."""
    found = lambda i: F.regexp_extract(name, r"^h2h_\d+_(.*)_vs_(.*)\.html", i)
    named = F.regexp_like(name, F.lit(r"^h2h_\d+_.*_vs_.*\.html"))
    return tuple(F.when(named, F.replace(found(i), F.lit("_"), F.lit(" "))) for i in (1, 2))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "_")


def label_line(cls: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, cx, cy, w, h)


def label_parts(line: Column) -> dict[str, Column]:
    """class, cx, cy, w, h of a label line; null for lines with fewer than five parts."""
    parts = F.split(F.trim(line), r"\s+")
    get = lambda i, t: F.when(F.size(parts) >= 5, F.get(parts, F.lit(i)).try_cast(t))
    return {"cls": get(0, "int"), **{n: get(i, "double") for i, n in enumerate(("cx", "cy", "w", "h"), 1)}}


def forecast(a: Column, b: Column, chance_a: Column, matches: Column, wins_a: Column, wins_b: Column, recent: Column) -> Column:
    """The forecast of a pairing: both chances in percent, the head to head, and its last result. A fixed format."""
    first = F.round(chance_a * 100, 1)
    lines = "%-22s %5.1f%% chance to win\n%-22s %5.1f%% chance to win\nHead-to-Head (%d matches): %s %d – %d %s\n%s"
    return F.format_string(lines, a, first, b, F.round(100 - first, 1), matches, a, wins_a, wins_b, b, recent)
