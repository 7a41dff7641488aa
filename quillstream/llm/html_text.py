"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"  # comment, to the end where it isn't closed
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",  # quotes that don't pair, or cut off
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Stand inside a line of text and are no part of it.
_CONTROLS = frozenset("button select option optgroup object audio video canvas svg math map input label textarea iframe script style noscript template meter progress".split())
#: No part of the text, unless they hold it.
_BESIDE = frozenset("nav footer aside dialog menu fieldset form".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NAMES = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|sidebar|menu|nav\w*|breadcrumbs?|masthead|foot(?:er)?|comments?|disqus|repl(?:y|ies)|respond"
    r"|cookies?|consent|gdpr|popup|modal|overlay|subscri\w*|newsletter|signup|login|share\w*|sharing|social|related|recommend\w*|widget|pagination|pager|toolbar|skip)",
    re.I,
)
#: Names that say so alone, or with a word for a box.
_BOXES = re.compile(
    r"(?:header|notices?|alerts?)(?:-(?:box|bar|area|wrap|wrapper|container|inner|outer|top|main|section|content|message|msg|text|info|warning|success|danger|error|block|list|item|\d+))*"
    r"|(?:\w+-)*(?:notices?|alerts?)|(?:site|page|top|main|global|app)-header(?:-\w+)*|side-bar(?:-\w+)*|sign-up(?:-\w+)*|more-stories",
    re.I,
)
#: Words that a name may hold besides without meaning anything else.
_BOX_WORDS = re.compile(
    r"(?:box|bar|area|wrap|wrapper|container|inner|outer|top|bottom|left|right|main|section|content|block|list|item|items|links?|btns?|buttons?|icons?|posts?|articles?|stories|form|slot|unit|tools|tags?|title|heading"
    r"|text|group|row|col|column|panel|cards?|feed|thread|author|body|page|site|inline|mobile|desktop|js|no|s|m|l|xs|sm|md|lg|xl|\d+)",
    re.I,
)
#: Inside an article these are judged by their text: a recipe has a menu.
_MAYBE = re.compile(r"(?:menu|nav\w*|related|recommend\w*|share\w*|sharing|social|widget|toolbar|pagination|pager|breadcrumbs?|skip)", re.I)
_COMMENTS = re.compile(r"(?:comments?|disqus|repl(?:y|ies)|respond)", re.I)
#: Tokens that speak of the page around: a site that has a sidebar isn't one.
_STATES = re.compile(r"(?:has|with|without|no|not|is|hide|show|one|two)-.*|.*-(?:open|opened|closed|enabled|disabled|allowed|on|off|active|visible|left|right)", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_END = {tag: re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I) for tag in _RAW}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


#: What speaks against an element: nothing; a name of which only a part says so; one that is judged by its text; its whole name, role or tag; reader comments.
CLEAR, PART, MAYBE, BESIDE, COMMENTS = range(5)


def _suspicion(tag: str, values: dict[str, str], in_article: bool) -> int:
    """Do class and id say that the element is no part of the text?  Headings are judged by their text alone."""
    worst = CLEAR
    if tag in _HEADINGS:
        return worst
    for token in f"{values.get('class', '')} {values.get('id', '')}".split():
        token = re.sub(r"[_:-]+", "-", token).strip("-")
        if _STATES.fullmatch(token) or in_article and "header" in token.lower():
            continue
        parts = token.split("-")
        named = [part for part in parts if _NAMES.fullmatch(part)]
        if _BOXES.fullmatch(token):
            worst = max(worst, BESIDE)
        elif named and not all(_NAMES.fullmatch(part) or _BOX_WORDS.fullmatch(part) for part in parts):
            worst = max(worst, PART)
        elif named:
            worst = max(worst, COMMENTS if any(map(_COMMENTS.fullmatch, named)) else MAYBE if all(map(_MAYBE.fullmatch, named)) else BESIDE)
    return worst


class _Page:
    """Parallel lists: nodes in page order with parent, tag, pruned, suspicion; blocks of text, each with its node and its pieces.

    A piece is what stands between two tags: it belongs to the innermost element around it, so parts of a line may go while the line
    stays.  One pass; each step costs the same however deep the page is nested.
    """

    def __init__(self, page: str) -> None:
        self.parent, self.tag, self.pruned, self.suspect, self.block_of = [-1], ["#"], [False], [CLEAR], [0]
        self.within, self.muted = [False], [False]  # in an article; inside a control
        self.raw_blocks: list[tuple[int, list[tuple[int, str, bool]]]] = []
        self.stack, self.open = [0], Counter()
        pieces: list[tuple[int, str, bool]] = []
        at = 0

        def flush() -> None:
            nonlocal pieces
            if pieces:
                self.raw_blocks.append((self.block_of[pieces[0][0]], pieces))
                pieces = []

        while True:
            # from here on only: what a script holds is passed over unread
            m = _TOKEN.search(page, at)
            end = m.start() if m else len(page)
            if end > at:
                pieces.append((self.stack[-1], html.unescape(page[at:end]), self.open["a"] > 0))  # a reference ends with its text
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing = name.lower(), bool(m[1] or m[4])
            if tag == "br":
                pieces.append((self.stack[-1], " ", False))
                continue
            muted, in_line = self.muted[self.stack[-1]], tag in _INLINE or tag in _CONTROLS
            if closing:
                self._close(tag)
                if not in_line and not (muted and self.muted[self.stack[-1]]):
                    flush()
                continue
            if not in_line and not muted:
                flush()
            if tag in _RAW:
                over = _END[tag].search(page, at)
                at = over.end() if over else len(page)
            elif tag not in _VOID:
                self._open(tag, m[3] or m[6] or "")
        flush()

    def _cut(self, i: int) -> None:
        """Close the open elements from the ``i``-th on."""
        for n in self.stack[i:]:
            self.open[self.tag[n]] -= 1
        del self.stack[i:]

    def _close(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            own = self.tag[self.stack[i]]
            if own == tag:
                self._cut(i)
                return
            if tag in _INLINE and own not in _INLINE:
                return

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE and tag not in _CONTROLS and self.open["p"]:
            # a block ends an open paragraph
            for i in range(len(self.stack) - 1, 0, -1):
                if self.tag[self.stack[i]] == "p":
                    self._cut(i)
                    break
                if self.tag[self.stack[i]] not in _INLINE:
                    break
        if tag in _CLOSES and any(self.open[x] for x in _CLOSES[tag][0]):
            ends, within = _CLOSES[tag]
            for i in range(len(self.stack) - 1, 0, -1):
                if self.tag[self.stack[i]] in within:
                    break
                if self.tag[self.stack[i]] in ends:
                    self._cut(i)
                    break
        parent = self.stack[-1]
        drop, suspect = self.pruned[parent] or tag in _CONTROLS, CLEAR
        article = self.open["article"] > 0
        if not drop and tag not in ("html", "body"):
            in_article = article or self.open["main"] > 0
            suspect = (MAYBE if tag == "aside" else BESIDE) if tag in _BESIDE or tag == "header" and not in_article else CLEAR
            if attributes:
                values = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
                drop = values.get("aria-hidden", "").lower() == "true" or "hidden" in values or "display:none" in values.get("style", "").replace(" ", "").lower()
                if values.get("role", "").lower() in _ROLES:
                    suspect = BESIDE
                suspect = max(suspect, _suspicion(tag, values, in_article))
        if suspect and tag in _INLINE:
            drop, suspect = suspect > PART or not article, CLEAR
        here = len(self.tag)
        self.parent.append(parent)
        self.tag.append(tag)
        self.pruned.append(drop)
        self.suspect.append(suspect)
        self.within.append(article)
        self.muted.append(self.muted[parent] or tag in _CONTROLS)
        self.block_of.append(self.block_of[parent] if tag in _INLINE or tag in _CONTROLS else here)
        self.stack.append(here)
        self.open[tag] += 1

    def prune(self) -> None:
        """Drop the suspected elements, but for those that hold the article or nearly all of the page's text.

        Inside an article a name of which a part says so, an aside, and what an article may have of its own (``_MAYBE``) go only
        where their text says so too: links, or no sentence of some length.
        """
        n = len(self.tag)
        nearest, own, chars, linked, ends = [0] * n, [0.0] * n, [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            nearest[i] = i if self.suspect[i] else nearest[self.parent[i]]
        for _, pieces in self.raw_blocks:
            for node, text, in_link in pieces:
                if not self.pruned[node]:
                    size = len(text) if text and not text.isspace() else 0
                    own[nearest[node]] += 0 if in_link else size
                    chars[node] += size
                    linked[node] += size if in_link else 0
                    ends[node] += sum(map(text.count, ".!?。！？")) if size else 0
        for i in range(n - 1, 0, -1):  # parents come before their children
            for total in (chars, linked, ends):
                total[self.parent[i]] += total[i]
        commented, holds, any_holds = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            commented[i] = self.suspect[i] == COMMENTS or commented[self.parent[i]]
        for i in range(n - 1, 0, -1):
            article = self.tag[i] in ("article", "main") and not self.suspect[i] and not self.pruned[i]
            for flags, counts in ((holds, article and not commented[i]), (any_holds, article)):
                if counts or flags[i] and not (self.suspect[i] and self.tag[i] in ("article", "main")):
                    flags[i] = flags[self.parent[i]] = True
        if not holds[0]:
            holds = any_holds
        for i in range(1, n):
            wraps = holds[i] or own[i] > 10 * own[0]
            spared = False
            if self.within[i] and self.suspect[i] in (PART, MAYBE):
                prose = linked[i] * 4 < chars[i] and (self.tag[i] == "menu" or ends[i] > 0 and chars[i] >= 60 or chars[i] >= 200)
                spared = linked[i] * 2 < chars[i] if self.suspect[i] == PART else prose
            self.pruned[i] = self.pruned[i] or self.pruned[self.parent[i]] or self.suspect[i] > CLEAR and not wraps and not spared

    def blocks(self) -> list[tuple[int, str, int]]:
        """Node, text and characters inside links of each block of which a piece is left."""
        out = []
        for node, pieces in self.raw_blocks:
            left = [x for x in pieces if not self.pruned[x[0]]]
            text = " ".join("".join(x[1] for x in left).split())
            if text:
                out.append((node, text, min(len(text), sum(len(x[1]) for x in left if x[2]))))
        return out


def main_text(page: str | None) -> str:
    """The best container's blocks (and its siblings'), joined by an empty line; empty if there is no text."""
    if not page:
        return ""
    tree = _Page(page)
    tree.prune()
    blocks = tree.blocks()
    if not blocks:
        return ""
    n = len(tree.tag)
    score, chars, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, in_links in blocks:
        points = 1.0 + len(text) / 100 + text.count(",") + text.count("、") + text.count("，")
        points *= 1 - in_links / len(text)
        if tree.tag[node] in ("div", "section", "article", "main", "body", "td", "form"):
            score[node] += points  # bare text of a container
        share, up = 1.0, tree.parent[node]
        while up > 0 and share > 0.1:
            score[up] += points * share
            share /= 2
            up = tree.parent[up]
        chars[node] += len(text)
        linked[node] += in_links
    for i in range(n - 1, 0, -1):  # parents come before their children
        chars[tree.parent[i]] += chars[i]
        linked[tree.parent[i]] += linked[i]
    for i in range(n):
        if tree.tag[i] in ("article", "main"):
            score[i] *= 1.5
        if chars[i]:
            score[i] *= 1 - linked[i] / chars[i]
    best = max(range(n), key=lambda i: (score[i], -i))
    if score[best] <= 0:
        best = 0
    up = best
    while up > 0:
        if tree.tag[up] == "article":
            best = up
            break
        up = tree.parent[up]
    kept = {best}
    if best > 0 and tree.tag[best] not in ("article", "main", "body", "html"):
        for i in range(n):
            if i != best and tree.parent[i] == tree.parent[best] and not tree.pruned[i] and chars[i]:
                good = score[i] >= max(3.0, 0.2 * score[best])
                if good or linked[i] / chars[i] < 0.25:
                    kept.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in kept or (i > 0 and inside[tree.parent[i]])
    if 0 in kept:
        inside = [True] * n
    return "\n\n".join(text for node, text, _ in blocks if inside[node])


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        text = f["html"].map(main_text, na_action=None)
        yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": text, "n_chars": text.str.len().astype("int64")})


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``.

    Each block of text passes points for its length and commas to its ancestors, halved at each step and discounted by
    the share of its characters that lie in links; the element with most points, its article if it lies in
    one, and its good siblings are kept.  Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    hidden elements and reader comments are left out before, by tag, role or name; an element so named that holds the article, or ten times
    the text of all that isn't suspected, is a wrapper and stays, and inside an article a name that may mean its subject needs links or
    scraps of text besides.  Parts of a line go without the line.  Character references are decoded, white space in a block
    becomes one space, blocks keep their page order and are joined by an empty line.

    Null or empty html gives an empty text; pages are independent rows, so repeated rows and null ids stay; tags that are
    never closed or cut off are read as browsers do; the work grows with the page's length, however deep it is nested; an empty table gives no rows.  Other columns are ignored.
    """
    few = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    return few.mapInPandas(_extract, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract_text(table(spark, sf_dir, "pages"))
