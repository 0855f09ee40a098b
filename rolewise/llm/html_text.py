"""Main text of web pages by tree scoring.

The page becomes a tree.  Parts that are never the article (navigation, scripts, adverts, reader comments and so on,
by element or by class and id) go; a part with a telling name, or a form, only if the rest of the page has text to speak of, as such names
stand around articles too.  Each paragraph then passes points for its length and commas to its ancestors, less
with each step and less the more of it is links; the container with the most points is the article.  Its siblings are
kept if they are headings or hold points or text of their own like an article's.  Within the article only whole names of adverts,
sharing, comments and the like are dropped, and its lists of links stay; where the best container is the page itself, both rules are as outside.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolewise.llm.common import in_batches

#: Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = set("b i em strong u s small big font tt code a abbr cite q sub sup mark kbd samp var time bdi bdo del ins label acronym strike".split())
INLINE = FORMATTING | set("span img br wbr input".split())
NEVER = set("head script style noscript template nav footer aside iframe button select textarea option dialog svg canvas object embed menu".split())
PARAGRAPH = set("p figcaption pre td th li blockquote h1 h2 h3 h4 h5 h6 dd dt address".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
SAFE = set("html body article main".split())
#: Words in a class or id that name what an article is not.
UNWANTED = set(
    "ad ads adbox advert advertisement adverts advertising sponsor sponsored promo promotion banner sidebar aside comment comments commentlist disqus reply replies respond"
    " cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead topbar share sharing social related recommended widget pagination pager toolbar skip paywall login copyright".split()
)
#: Whole names that are no article within one either: those of a class, and those of an id, as an id often names a section's topic.
ALWAYS_IDS = set(
    "ad ads adbox advert advertisement adverts advertising ad-banner ad-container ad-slot ad-box ad-unit sponsored-content comment comments commentlist comment-list"
    " comments-area comments-section comment-section comment-form disqus disqus-thread respond share-buttons share-bar social-share social-links"
    " sidebar nav navbar main-menu site-footer cookie-banner cookie-notice cookie-consent newsletter-signup related-posts related-articles".split()
)
ALWAYS = ALWAYS_IDS | set("sponsor sponsored promo promotion reply replies share sharing social menu footer breadcrumb breadcrumbs newsletter pagination pager toolbar".split())
#: Whole names of reader comments, which may well be longer than the article.
COMMENTS = set("comment comments commentlist comment-list comments-area comments-section comment-section comment-form disqus disqus-thread respond reply replies".split())
#: Words that a class begins or ends with, and whole ids, of parts that are no article within one either, if they have little of its points.
WITHIN = set(
    "ad ads adbox advert advertisement adverts advertising sponsor sponsored promo promotion notice notices cookie cookies consent gdpr alert newsletter subscribe subscription signup popup modal overlay"
    " menu nav navbar navigation breadcrumb breadcrumbs sidebar pagination pager toolbar paywall".split()
)
_SEGMENT = re.compile(r"[-_]|(?<=[a-z])(?=[A-Z])")
#: Shortest paragraph that passes points, and the points that an article element has of its own.
LEAST, ARTICLE_POINTS = 25, 25.0
#: A part with an unwanted name stays if it has more than this share of all points: a name that begins or ends so, and a whole one.
MOST, MOST_WHOLE = 0.5, 0.8
#: A part within an article whose name only begins or ends with an unwanted word is the article's own if it has more than this share of its points.
MOST_WITHIN = 0.25


def _named_unwanted(attrs: list[tuple[str, str | None]]) -> bool:
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for name in value.split():
                parts = [p.lower() for p in _SEGMENT.split(name) if p]
                if parts and parts[0] not in TURNED and {parts[0], parts[-1]} & UNWANTED:
                    return True
        elif key == "hidden" or (key == "style" and value and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            return True
    return False


#: How an element is out: not at all, by a name, by one that tells within an article, too, by a whole name, as reader comments, and always.
IN, NAMED, INNER, WHOLE, COMMENT, ALWAYS_OUT = range(6)
#: Words before a name that turn it round.
TURNED = ("has", "with", "no", "without", "is")


def _how_out(attrs: list[tuple[str, str | None]]) -> int:
    found = NAMED if _named_unwanted(attrs) else IN
    for key, value in attrs:
        if key in ("class", "id") and value:
            names = [parts for name in value.split() if (parts := [p.lower() for p in _SEGMENT.split(name) if p]) and parts[0] not in TURNED]
            whole = {"-".join(parts) for parts in names}
            # reader comments are such whatever they are of, and may be longer than the article
            if whole & COMMENTS or any(parts[-1] == "comments" or parts[0] == "comments" for parts in names):
                return COMMENT
            if whole & (ALWAYS if key == "class" else ALWAYS_IDS):
                found = max(found, WHOLE)
            elif whole & WITHIN or (key == "class" and any({parts[0], parts[-1]} & WITHIN for parts in names)):
                found = max(found, INNER)
        elif key in ("hidden", "style") and _named_unwanted([(key, value)]):
            return ALWAYS_OUT
        elif key == "role" and _named_unwanted([(key, value)]):
            found = max(found, WHOLE)
    return found


class _Tree(HTMLParser):
    """Nodes in page order with their parents, and the texts between block boundaries."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent = ["#page"], [0]
        #: how each element is out by itself, and the nearest element that isn't inline
        self.how, self.block = [IN], [0]
        #: the open elements, and where on that stack those of each name are
        self.open, self.at, self.links = [0], defaultdict(list), 0
        #: runs of text: [node of the first text, [(text, in a link)]]
        self.runs: list[tuple[int, list[tuple[str, bool]]]] = []
        self.fresh = True

    def _close_to(self, at: int) -> None:
        for node in self.open[at:]:
            self.at[self.tag[node]].pop()
        del self.open[at:]
        self.fresh = True

    def _open_at(self, names: set[str], stop: set[str]) -> int:
        """The place on the stack of the innermost open element of ``names`` above any of ``stop``; 0 if none."""
        found = max((self.at[n][-1] for n in names if self.at[n]), default=0)
        return found if found and found >= max((self.at[n][-1] for n in stop if self.at[n]), default=0) else 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.links = 1
        if tag in VOID or tag in FORMATTING:
            if tag in ("br", "hr"):
                self.handle_data("\n")
                self.fresh |= tag == "hr"
            return
        if tag not in INLINE:
            self.fresh = True
            stop = set("div article section main td th table ul ol body li blockquote dl".split())
            if k := self._open_at({"p"}, stop):
                self._close_to(k)
            same = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "body": {"head"}}.get(tag)
            if same and (k := self._open_at(same, {"ul", "ol", "dl", "table"} - same)):
                self._close_to(k)
        up = self.open[-1]
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.block.append(self.block[up] if tag in INLINE else node)
        if tag in NEVER or (tag == "header" and not (self.at["article"] or self.at["main"])):
            self.how.append(ALWAYS_OUT)
        else:
            self.how.append(IN if tag in SAFE else max(_how_out(attrs), WHOLE if tag == "form" else IN))
        self.at[tag].append(len(self.open))
        self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as in HTML, only void elements end here

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag in VOID or tag in FORMATTING:
            return
        if tag in INLINE:
            if self.tag[self.open[-1]] == tag:
                self.open.pop()
                self.at[tag].pop()
            return
        self.fresh, self.links = True, 0
        if k := self._open_at({tag}, set()):
            self._close_to(k)

    def handle_data(self, data: str) -> None:
        if self.fresh:
            if data.isspace():
                return
            self.runs.append((self.open[-1], []))
            self.fresh = False
        self.runs[-1][1].append((data, bool(self.links)))


class _Block:
    __slots__ = ("linked", "node", "text", "worth")

    def __init__(self, node: int, parts: list[tuple[str, bool]]):
        self.node, self.worth = node, 0.0
        self.text = " ".join("".join(t for t, _ in parts).split())
        linked = sum(len(" ".join(t.split())) for t, in_link in parts if in_link)
        self.linked = min(1.0, linked / max(len(self.text), 1))


def _left_out(tree: _Tree, blocks: list[_Block]) -> tuple[list[bool], list[bool]]:
    """For each node whether it is out, and whether it is out within an article, too.

    What is out by its name, other than reader comments, stays if it has most of the points of what isn't out anyway.
    """
    always = [h >= COMMENT for h in tree.how]
    points = [0.0] * len(tree.tag)
    for k in range(1, len(always)):
        always[k] |= always[tree.parent[k]]
    if not any(b.worth and not always[b.node] for b in blocks):  # nothing but comments
        for k in range(1, len(always)):
            always[k] = tree.how[k] == ALWAYS_OUT or always[tree.parent[k]]
    for b in blocks:
        if not always[b.node]:
            points[b.node] += b.worth
    for k in range(len(points) - 1, 0, -1):
        points[tree.parent[k]] += points[k]
    out, never = list(always), list(always)
    for k in range(1, len(out)):
        up = tree.parent[k]
        never[k] |= never[up] or (tree.how[k] == WHOLE and points[k] <= MOST_WHOLE * points[0])
        out[k] |= out[up] or never[k] or (NAMED <= tree.how[k] <= INNER and points[k] <= MOST * points[0])
    return out, never


def main_text(html: str | None) -> str:
    """The article of a page, its blocks in page order joined by two line feeds; empty if there is none."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tag, parent = tree.tag, tree.parent
    every = [b for node, parts in tree.runs if (b := _Block(node, parts)).text]
    long_enough = LEAST if any(len(b.text) >= LEAST for b in every) else 1
    for b in every:
        if len(b.text) >= long_enough and tag[tree.block[b.node]] not in HEADING:
            b.worth = (1 + b.text.count(",") + min(len(b.text) / 100, 3)) * (1 - b.linked)
    out, never = _left_out(tree, every)
    every = [b for b in every if not never[b.node]]
    blocks = [b for b in every if not out[b.node]]
    if not blocks:
        return ""

    size, linked, points = [0] * len(tag), [0.0] * len(tag), [0.0] * len(tag)
    for b in blocks:
        own = tree.block[b.node]
        size[own] += len(b.text)
        linked[own] += len(b.text) * b.linked
        if b.worth:
            up = parent[own] if tag[own] in PARAGRAPH else own
            for step in range(5):
                points[up] += b.worth / (1, 2, 6, 9, 12)[step]
                if not up:
                    break
                up = parent[up]
    for k in range(len(tag) - 1, 0, -1):  # children come after their parents
        size[parent[k]] += size[k]
        linked[parent[k]] += linked[k]
    density = [x / s if s else 0.0 for x, s in zip(linked, size, strict=True)]
    score = [(p + ARTICLE_POINTS * (tag[k] in ("article", "main"))) * (1 - density[k]) if size[k] else -1.0 for k, p in enumerate(points)]
    best = max(range(len(tag)), key=lambda k: (score[k], -k))
    keep = [False] * len(tag)
    enough = max(10.0, 0.2 * score[best])
    lists_of_links = {"ul", "ol", "div", "table", "section"}
    # names and lists of links within an article are its own; in a whole page they are menus and the like
    whole_page = tag[best] in ("#page", "html", "body")
    inside = [False] * len(tag)
    # of a container, but not of a whole page, the next parts with paragraphs are the article's end or beginning
    of_article = tag[parent[best]] not in ("#page", "html", "body")
    spoken = [False] * len(tag)
    for b in blocks:
        spoken[b.node] |= tag[tree.block[b.node]] == "p"
    weight = [0.0] * len(tag)
    for b in every:
        weight[b.node] += b.worth
    for k in range(len(tag) - 1, 0, -1):
        spoken[parent[k]] |= spoken[k]
        weight[parent[k]] += weight[k]
    inner = [False] * len(tag)
    for k in range(1, len(tag)):
        inner[k] = inner[parent[k]] or (tree.how[k] == INNER and k != best and weight[k] <= MOST_WITHIN * weight[best])
    for k in range(len(tag)):
        inside[k] = not whole_page and (k == best or (k > 0 and inside[parent[k]] and not inner[k]))
        if k == best or inside[k]:
            keep[k] = True
        elif k and inner[k] and inside[parent[k]]:
            keep[k] = False
        elif best and k and parent[k] == parent[best]:
            text_like = tag[k] in PARAGRAPH and (size[k] > 80 and density[k] < 0.25)
            keep[k] = score[k] >= enough or text_like or (tag[k] in HEADING and density[k] < 0.5) or (of_article and spoken[k] and density[k] < 0.25)
        elif k:
            keep[k] = keep[parent[k]] and not inner[k] and not (tag[k] in lists_of_links and density[k] > 0.5)
    return "\n\n".join(b.text for b in every if keep[b.node] and (inside[b.node] or not out[b.node]))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points of the text) of each row of ``pages``.

    A null or empty html, and a page of which nothing is an article, have the empty text.  Repeated rows stay; extra
    columns are left out; an empty table gives an empty one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return in_batches(pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")), run, f"page_id {kind}, url string, text string, n_chars bigint")
