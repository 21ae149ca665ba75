"""Main-text extraction with a tree-structured graphical model over the DOM.

Every element is a binary variable, content or not. A node potential comes from its features, an edge potential joins it
to its parent; both are smoothed log ratios of counts over labelled pages. Messages pass up the tree and down again
(sum-product), which gives every element's exact marginal. Elements that are never main text, such as menus, forms and
scripts, are fixed to "not content" as evidence, and so is what stands outside of the article that a page marks. Pages
are also fitted on without their articles' tags, so that the model holds for pages that mark none.
"""

from __future__ import annotations

import copy
import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm.common import table

#: Labelled pages that the model is fitted on, at most.
TRAINING_PAGES = 512
SMOOTHING = 0.5

#: Element names by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NEVER = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "header", "iframe", "input", "label", "legend", "menu", "nav", "noscript", "object", "script", "select", "style",
    "svg", "template", "textarea", "title", "video",
}
NEVER_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
NEVER_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promoted", "promotion", "related", "replies", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget",
}
#: As the last part of a block's class or id (user-comments, but not related-work) these bar it, also in an article; the other names are a feature of the model.
BARRING_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "navbar", "newsletter", "replies", "sidebar", "teaser", "teasers",
}
#: What a name that begins with comment may end with, and what a header's may begin with, unless it is an article's own.
COMMENT_PARTS, SITE = {"area", "body", "form", "list", "section", "thread"}, {"global", "page", "site", "top"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: The ids of these are anchors in the text.
ANCHORS = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
#: With one of these, an element's name says what else its page has.
KEPT_NAMES = {"has", "layout", "no", "with", "without"}
MAIN = {"article", "main"}
ROOTS = {"#page", "html", "body"}
#: Elements whose text no reader sees; the model learns nothing from them.
UNSEEN = {"audio", "canvas", "datalist", "head", "iframe", "noscript", "object", "script", "style", "svg", "template", "title", "video"}
#: An open element of the first kind ends when one of the second starts in it.
CLOSES = {"p": BLOCK - {"option"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Elements that an implied end doesn't reach beyond.
SCOPES = {"article", "aside", "body", "dl", "div", "footer", "form", "html", "main", "nav", "ol", "section", "table", "ul"}


class Page(HTMLParser):
    """The elements of a page in page order, each after its parent, and its text pieces with the block ends between them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.never, self.inside, self.named = ["#page"], [-1], [False], [False], [False]
        self.by_name = [False]
        self.pieces: list[tuple[int, str] | None] = []
        self.open, self.often = [0], Counter()
        self.feed(html)
        self.close()
        self._settle()

    def _settle(self) -> None:
        """What only the whole page tells: a form or a named block around the page's article, or around most of its text, bars nothing.

        An article's own header is text if it has a heading. What a block is named after holds for all that stands in it.
        """
        n = len(self.tags)
        holds, headed, seen = [t in MAIN or t == "h1" for t in self.tags], [t in HEADINGS for t in self.tags], [0] * n
        for piece in self.pieces:
            if piece:
                seen[piece[0]] += len(piece[1].strip())
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            holds[up], headed[up] = holds[up] or holds[i], headed[up] or headed[i]
            if self.tags[i] not in UNSEEN:
                seen[up] += seen[i]
        for i in range(1, n):
            around = holds[i] or 2 * seen[i] > seen[0]
            if self.tags[i] == "form" and around:
                self.never[i] = False
            elif self.tags[i] == "header" and self.inside[i] and headed[i] and not self.by_name[i]:
                self.never[i] = False
            self.never[i] = self.never[i] or (self.by_name[i] and not holds[i])
            self.named[i] = self.named[self.parents[i]] or (self.named[i] and not holds[i])

    def _end(self, at: int) -> None:
        """Closes the elements from a place in the list of open ones on."""
        self.often.subtract(self.tags[i] for i in self.open[at:])
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.pieces.append(None)
            ends = any(self.often[inner] and tag in by for inner, by in CLOSES.items())
            for at in range(len(self.open) - 1, 0, -1) if ends else ():
                inner = self.tags[self.open[at]]
                if tag in CLOSES.get(inner, ()):
                    self._end(at)
                    break
                if inner in SCOPES:
                    break
        elif tag == "br":
            self.pieces.append((self.open[-1], " "))
        if tag in VOID:
            return
        parent, given = self.open[-1], dict(attrs)
        names = self._names(tag, given)
        if tag == "article" and self._names(tag, {"class": next(iter((given.get("class") or given.get("id") or "").split()), "")}) & BARRING_NAMES:
            tag = "div"  # by its first name a reader's comment, or a piece of another article
        whole = tag in MAIN or tag in ("html", "body")  # these may be named after any of their parts
        self.parents.append(parent)
        self.tags.append(tag)
        self.never.append(tag in NEVER or (not whole and self._unwanted(given)))
        self.by_name.append(not whole and tag in BLOCK and bool(names & BARRING_NAMES))
        self.named.append(not whole and bool(names & NEVER_NAMES))
        self.inside.append(self.inside[parent] or tag in MAIN or given.get("role") == "main")
        self.open.append(len(self.tags) - 1)
        self.often[tag] += 1

    @staticmethod
    def _names(tag: str, attrs: dict[str, str | None]) -> set[str]:
        """What its classes and its id call an element: the last part of each, as a compound name such as related-work may begin with anything."""
        names = f"{attrs.get('class') or ''} {(tag not in ANCHORS and attrs.get('id')) or ''}".lower().split()
        out, parted = set(), [re.split("[-_]+", name) for name in names]
        if any(len(parts) == 1 and parts[0] in KEPT_NAMES for parts in parted):
            return out
        for parts in parted:
            if KEPT_NAMES.intersection(parts):
                continue
            if parts[-1] != "header" or len(parts) == 1 or parts[0] in SITE:
                out.add(parts[-1])
            if parts[0] == "comment" and parts[-1] in COMMENT_PARTS:
                out.add("comments")
        return out

    @staticmethod
    def _unwanted(attrs: dict[str, str | None]) -> bool:
        hidden = "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
        return hidden or (attrs.get("role") or "").lower() in NEVER_ROLES

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.pieces.append(None)
        if not self.often[tag]:
            if tag == "article" and self.often["div"]:
                tag = "div"  # one that counts as another block
            else:
                return
        for at in range(len(self.open) - 1, 0, -1):
            if self.tags[self.open[at]] == tag:
                self._end(at)
                return

    def handle_data(self, data: str) -> None:
        self.pieces.append((self.open[-1], data))

    def features(self) -> list[tuple[str, ...]]:
        """The kind of each block element: in a marked article, named as a part, a root without text, links, or text.

        Which block it is says nothing: menus and articles both have lists, and a paragraph may be a ``div``. Elements
        within a line have no features of their own.
        """
        n = len(self.tags)
        own, in_link = [0] * n, [False] * n
        for piece in self.pieces:
            if piece:
                own[piece[0]] += len(piece[1].strip())
        for i in range(1, n):
            in_link[i] = self.tags[i] == "a" or in_link[self.parents[i]]
        whole = list(own)
        linked = [o if link else 0 for o, link in zip(own, in_link, strict=True)]
        for i in range(n - 1, 0, -1):
            if self.tags[i] not in UNSEEN:
                whole[self.parents[i]] += whole[i]
                linked[self.parents[i]] += linked[i]
            if not self.is_block(i) and not self.never[i]:
                own[self.parents[i]] += own[i]
        out: list[tuple[str, ...]] = []
        follows, cites = [False] * n, [False] * n  # whether a text block stands in the element so far; whether it cites
        for i in range(n):
            if not self.is_block(i):
                out.append(())
            elif self.inside[i]:
                out.append(("kind article",))
            elif self.named[i]:
                out.append(("kind named",))
            elif self.tags[i] in ROOTS and not own[i]:
                out.append(("kind root",))
            else:
                up = self.parents[i]
                links = whole[i] and 4 * linked[i] >= 3 * whole[i]
                # a list of links after text in one block is the text's own, as sources are
                cites[i] = bool(links and i and (cites[up] or (follows[up] and self.tags[up] not in ROOTS)))
                out.append(("kind links" if links and not cites[i] else "kind text",))
                follows[up] = follows[up] or (bool(i) and not links and whole[i] > 0)
        return out

    def is_block(self, i: int) -> bool:
        return self.tags[i] in BLOCK or self.tags[i] in ROOTS

    def barred(self) -> list[bool]:
        """Whether an element or one above it is never main text."""
        out = list(self.never)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parents[i]]
        return out

    def fixed(self) -> list[bool]:
        """Whether an element is barred, or stands outside of the article that its page marks."""
        marked = any(self.inside)
        return [b or (marked and not i) for b, i in zip(self.barred(), self.inside, strict=True)]

    def unseen(self) -> list[bool]:
        """Whether no reader sees an element's text."""
        out = [tag in UNSEEN for tag in self.tags]
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parents[i]]
        return out

    def unmarked(self) -> Page:
        """The page without its articles' own tags: what they hold stands in their parents."""
        out = copy.copy(self)
        keep = [i for i, tag in enumerate(self.tags) if tag not in MAIN]
        place = {i: at for at, i in enumerate(keep)}
        for i, tag in enumerate(self.tags):
            if tag in MAIN:
                place[i] = place[self.parents[i]]
        out.tags, out.never = [self.tags[i] for i in keep], [self.never[i] for i in keep]
        out.parents = [place[self.parents[i]] if i else -1 for i in keep]
        out.inside, out.named = [False] * len(keep), [self.named[i] for i in keep]
        out.pieces = [piece and (place[piece[0]], piece[1]) for piece in self.pieces]
        return out


def observations(page: Page) -> Counter:
    """Counts of a labelled page: an element is content if it stands in the article and isn't barred.

    The page counts twice, as it is and without its articles' tags, when an article's parent is content as well. Of the
    barred elements, those of links or a part's name tell what menus and parts are like. The others don't count, as what bars them is no feature.
    """
    counts: Counter = Counter()
    if not any(page.inside):
        return counts
    barred = page.barred()
    bare = page.unmarked()
    content = [i and not b for i, b in zip(page.inside, barred, strict=True)]
    holds = {page.parents[i] for i, tag in enumerate(page.tags) if tag in MAIN and content[i]}
    kept = [i for i, tag in enumerate(page.tags) if tag not in MAIN]
    for view, state in ((page, content), (bare, [content[i] or i in holds for i in kept])):
        out, fixed, unseen = view.barred(), view.fixed(), view.unseen()
        for i, features in enumerate(view.features()):
            if not out[i] or (features in (("kind links",), ("kind named",)) and not unseen[i]):
                counts.update((f, int(state[i])) for f in features)
            parent = view.parents[i]
            if view.is_block(i) and not (i and out[parent]) and not (out[i] and fixed[parent]):
                counts[f"edge {int(state[parent])}" if i else "root", int(state[i])] += 1
    return counts


class Model:
    """Log potentials from counts {(feature, state): n}; without counts, all are even."""

    def __init__(self, counts: dict[tuple[str, int], int]):
        total: Counter = Counter()
        values: Counter = Counter()
        for (feature, state), n in counts.items():
            total[feature.split(" ")[0], state] += n
        for feature in {f for f, _ in counts}:
            values[feature.split(" ")[0]] += 1
        share = lambda f, s: (counts.get((f, s), 0) + SMOOTHING) / (total[f.split(" ")[0], s] + SMOOTHING * (values[f.split(" ")[0]] + 1))
        self.node = {f: math.log(share(f, 1) / share(f, 0)) for f in {f for f, _ in counts} if f.split(" ")[0] not in ("edge", "root")}
        even = lambda f, s: (counts.get((f, s), 0) + SMOOTHING) / (counts.get((f, 0), 0) + counts.get((f, 1), 0) + 2 * SMOOTHING)
        self.edge = [[even(f"edge {p}", s) for s in (0, 1)] for p in (0, 1)]
        self.root = [even("root", s) for s in (0, 1)]

    def marginals(self, page: Page) -> list[float]:
        """Each element's probability to be content: messages from the leaves to the root, then from the root down."""
        (e00, e01), (e10, e11) = self.edge
        n, barred, fixed = len(page.tags), page.barred(), page.fixed()
        log_odds = [min(max(sum(self.node.get(f, 0.0) for f in fs), -300.0), 300.0) for fs in page.features()]
        own = [(1.0, 0.0) if b else (1 / (1 + math.exp(x)), 1 / (1 + math.exp(-x))) for x, b in zip(log_odds, fixed, strict=True)]
        belief, sent = list(own), [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            if barred[i]:
                continue  # a menu in an article says nothing against the article
            b0, b1 = belief[i]
            m0, m1 = e00 * b0 + e01 * b1, e10 * b0 + e11 * b1
            sent[i] = (m0, m1)
            p0, p1 = belief[page.parents[i]]
            p0, p1 = p0 * m0, p1 * m1
            belief[page.parents[i]] = (p0 / (p0 + p1), p1 / (p0 + p1)) if p0 + p1 > 0 else (1.0, 0.0)
        p0, p1 = belief[0][0] * self.root[0], belief[0][1] * self.root[1]
        out = [(p0 / (p0 + p1), p1 / (p0 + p1))] + [(0.0, 0.0)] * (n - 1)
        for i in range(1, n):
            a0, a1 = out[page.parents[i]]
            c0, c1 = a0 / max(sent[i][0], 1e-300), a1 / max(sent[i][1], 1e-300)  # the parent without this child's message
            b0, b1 = belief[i]
            q0, q1 = b0 * (c0 * e00 + c1 * e10), b1 * (c0 * e01 + c1 * e11)
            out[i] = (q0 / (q0 + q1), q1 / (q0 + q1)) if q0 + q1 > 0 else (1.0, 0.0)
        return [x for _, x in out]


def main_text(html: str, model: Model) -> str:
    page = Page(html)
    barred, marginals = page.barred(), model.marginals(page)
    wanted: list[bool] = []
    for i, m in enumerate(marginals):
        # an element within a line goes with its block, but an article's own tag can be within one
        follows = i and not page.is_block(i) and page.inside[i] == page.inside[page.parents[i]]
        wanted.append(not barred[i] and (wanted[page.parents[i]] if follows else m >= 0.5))
    blocks: list[list[str]] = [[]]
    for piece in page.pieces:
        if piece is None:
            blocks.append([])
        elif wanted[piece[0]]:
            blocks[-1].append(piece[1])
    lines = (" ".join("".join(block).split()) for block in blocks if block)
    return "\n".join(line for line in lines if line)


def fit(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", most: int = TRAINING_PAGES) -> dict[tuple[str, int], int]:
    """Counts over at most ``most`` labelled pages, those with an article, drawn by the hash of their id.

    Features have a fixed set of values, so the counts stay a few hundred numbers.
    """
    drawn = pages.filter(F.contains(F.lower(html_col), F.lit("<article"))).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(most)
    sample = pages.join(F.broadcast(drawn.filter(F.col(id_col).isNotNull()).distinct()), id_col, "left_semi").select(F.col(html_col).alias("html"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for frame in frames:
            for html in frame["html"].dropna():
                counts.update(observations(Page(html)))
        yield pd.DataFrame([(f, s, n) for (f, s), n in counts.items()], columns=["feature", "state", "n"])

    counted = sample.mapInPandas(count, "feature string, state int, n long").groupBy("feature", "state").agg(F.sum("n").alias("n"))
    return {(r["feature"], r["state"]): r["n"] for r in counted.collect()}


def extract(pages: DataFrame, counts: dict[tuple[str, int], int], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text (blocks joined by a line feed), n_chars in code points.

    Null or empty html has the empty text. Broken markup is read as browsers do in the main: open elements end with the
    page. Repeated rows, null ids and null urls pass through, one result row each. An empty table gives an empty result.
    Other columns of the input are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts)
        for batch in batches:
            texts = [main_text(html, model) if html else "" for html in batch.column("h_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h_id"), batch.column("h_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["h_id", "h_url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("h_id"), F.col(url_col).cast("string").alias("h_url"), F.col(html_col).cast("string").alias("h_html"))
    return rows.mapInArrow(run, f"h_id {kind}, h_url string, text string, n_chars long").withColumnsRenamed({"h_id": id_col, "h_url": url_col})


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


#: For pages of the test tables' make: the article's blocks by regular expressions.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
 b AS (SELECT page_id, url, string_split(regexp_replace(h, '</?(p|h1|li|ul|div)>', chr(1), 'g'), chr(1)) AS blocks FROM a),
 c AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM b),
 d AS (SELECT page_id, url, coalesce(list_aggregate(list_filter(blocks, lambda x: x <> ''), 'string_agg', chr(10)), '') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""
