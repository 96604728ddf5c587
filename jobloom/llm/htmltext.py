"""Main text of web pages by a maximum-scoring contiguous region.

A page is a line of words and tags. ``fit`` learns weights from labelled pages, which are those whose markup names its
article (an ``article`` or ``main`` element): what it costs a tag to stand in the line, inside a named article and
elsewhere, and how much each class, id and role token and each sectioning element speaks against the words below it.
A word scores 1 plus the weights of the elements around it, so it is positive in content and slightly negative in
boilerplate; tags score at most 0. One linear scan finds the contiguous region with the largest sum, and the region's
words of positive score are the text. The same scores and the same scan serve pages with and without an article.

Before anything is learnt a weight comes from a prior count (``PRIOR``), to which the labelled pages add their words.
Names speak relatively: a page's own level is the evidence that at least ``LEVEL`` of its words are free of, so that a
name on a wrapper of the page or of the article takes nothing away.

Text blocks are joined in page order; white space inside a block becomes one space; character references are decoded;
nothing else is dropped or cut.

Defined results: null or empty html gives empty text; end tags that HTML lets authors leave out are implied, stray end
tags ignored, elements that are never closed end with their parent; a quote or tag that never ends is a tag up to the
next ``>``; a page without a word of positive score gives empty text; columns of ``keep`` named like a result are left
out; rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, give_back, map_texts, pieces, read_table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|iframe)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)|<(title|textarea)\b[^>]*>.*?</\2\b[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Fixed values of the HTML standard: phrasing elements, elements without an end tag, elements of the head.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
# Fixed values of the HTML standard: elements whose end tag may be left out, with the start tags that end them, and
# the elements inside them within which such a start tag belongs to something else.
_CELLS, _ROWS = frozenset("td th".split()), frozenset("tr tbody thead tfoot".split())
ENDED_BY = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": _CELLS | _ROWS, "th": _CELLS | _ROWS, "tr": _ROWS,
    "tbody": _ROWS - {"tr"}, "thead": _ROWS - {"tr"}, "tfoot": _ROWS - {"tr"}, "option": frozenset(["option", "optgroup"]), "optgroup": frozenset(["optgroup"]),
}
WITHIN = dict.fromkeys(ENDED_BY, frozenset(["table"])) | {
    "p": frozenset("table button object".split()), "li": frozenset("ul ol menu dir".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
    "option": frozenset(["datalist"]), "optgroup": frozenset(["datalist"]),
}
ENDS = {t: [e for e, by in ENDED_BY.items() if t in by] for t in frozenset().union(*ENDED_BY.values())}
REGIONS = frozenset("article main".split())
HEADINGS, UNSEEN = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("head noscript template script style".split())
#: End tags that reach through cells and named articles; all others stop there.
FAR = frozenset("article main body html table tr tbody thead tfoot td th".split())

#: Words of content and of boilerplate that stand for a feature before labelled pages are read: nothing known, a
#: weak sign, a strong one. The weight of a feature is the logarithm of the ratio, between DEEPEST and 0.
PRIOR = {"none": (20.0, 20.0), "weak": (1.0, 8.0), "strong": (1.0, 55.0)}
DEEPEST = -4.0
# Sectioning and interactive elements of the HTML standard that hold no article text.
ELEMENTS = frozenset("nav header footer aside form dialog menu button fieldset head noscript template svg select option".split())
#: Name parts that the prior takes for signs of boilerplate; parts of headers, of states and of what a story is called.
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription"
    " nav navbar navigation topnav subnav menu menus submenu breadcrumb breadcrumbs sidebar sidebars footer masthead topbar toolbar comment comments commentlist disqus respond reply replies share shares"
    " sharing sharebar social related recommended recommendations widget widgets login signup signin search contentinfo complementary skip responses discussion guestbook alert alerts disclaimer paywall"
    " toast overlay lightbox siteheader".split()
)
#: Signs of remarks, which no labelled page makes content: readers write them below an article, often inside its element.
REMARKS = frozenset("comment comments commentlist disqus respond reply replies discussion guestbook".split())
HEADERS = frozenset("header heading".split())
STATES, STORIES = frozenset("with has no not is without show hide open".split()), frozenset("article post entry story".split())
#: Tags whose cost is known before learning, by (in content, elsewhere) occurrences; others start even.
TAG_PRIOR = {"a": (5.0, 20.0), "li": (5.0, 20.0)}
TAG_EVEN, TAG_LEAST, TAG_DEEPEST = (10.0, 10.0), -0.01, -0.75
#: Score of a word or tag of boilerplate: near 0, so that an aside does not cut a text in two. Inside a named article
#: it is 0: there the label says that the text goes on.
SKIPPED = -0.05
#: Share of a page's words that must be free of evidence for it to count against the others.
LEVEL = 0.05
#: A form that holds this share of a page's words is a wrapper; a named element that holds this share of a labelled
#: article's words is its text, whatever the prior takes its name for.
WRAPPED, BULK = 0.75, 0.5
#: Names of the model, those with most words outside articles, each on at least so many labelled pages. This bounds
#: the model, not the pages it is learnt from or applied to.
MODEL_NAMES, LEAST_PAGES = 50_000, 3


def names_of(attributes: str) -> tuple[str, ...]:
    """Class, id and role tokens as they stand."""
    if "=" not in attributes:
        return ()
    return tuple(t for m in NAMES.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split())


def sign(name: str) -> str:
    """What the prior knows of a name: strong if its last part is a sign, weak if another is, header, or none.

    A first part such as "with" makes it the name of a state of something else.
    """
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or (len(parts) > 1 and parts[0] in STATES):
        return "none"
    if parts[-1] in SIGNS:
        return "strong"
    if parts[-1] in HEADERS:
        return "none" if STORIES & set(parts) else "header"
    return "weak" if SIGNS & set(parts) else "none"


class Model:
    """Weights by feature: ``words`` of names and elements, ``tags`` by (inside a named article, tag)."""

    def __init__(self, words: dict[str, float] | None = None, tags: dict[tuple[bool, str], float] | None = None):
        self.words, self.tags = words or {}, tags or {}
        self.seen: dict[str, tuple[float, float, bool]] = {}

    def names(self, attributes: str) -> tuple[float, float, bool]:
        """Strong and weak evidence of an element's names, and whether they say that it is a header."""
        if (known := self.seen.get(attributes)) is None:
            strong = weak = 0.0
            header = False
            for name in names_of(attributes):
                kind = sign(name)
                learnt = self.words.get(f"name {name.lower()}")
                if kind == "header":
                    header = True
                elif kind == "weak" and (learnt is None or learnt > DEEPEST / 2):
                    weak = min(weak, weight("weak") if learnt is None else learnt)
                else:
                    strong = min(strong, (weight(kind) if learnt is None else learnt))
            if len(self.seen) > 50_000:
                self.seen.clear()
            known = self.seen[attributes] = (strong, weak, header)
        return known

    def element(self, tag: str) -> float:
        return self.words.get(f"element {tag}", weight("strong")) if tag in ELEMENTS else 0.0

    def outside(self) -> float:
        """Evidence against words outside the article of a page that names one."""
        return self.words.get("outside", weight("strong"))

    def tag(self, inside: bool, tag: str) -> float:
        return self.tags.get((inside, tag)) or tag_weight(inside, tag)


def weight(kind: str, content: float = 0.0, other: float = 0.0) -> float:
    a, b = PRIOR[kind]
    return min(0.0, max(DEEPEST, math.log((content + a) / (other + b))))


def tag_weight(inside: bool, tag: str, content: float = 0.0, other: float = 0.0) -> float:
    a, b = TAG_EVEN if inside else TAG_PRIOR.get(tag, TAG_EVEN)
    return min(TAG_LEAST, max(TAG_DEEPEST, math.log((content + a) / (other + b))))


class Page:
    """Elements of a page (parent, tag, attributes, whether it was closed) and its line of items (kind, element, text).

    Kinds: 0 text, 1 a tag that ends a block, 2 an inline tag; a tag's text is its name.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.attributes, self.closed = [0], [""], [""], [True]
        self.items: list[tuple[int, int, str]] = []
        lower = html.lower() if "</" in html else ""
        self.last = {t: lower.rfind(f"</{t}") for t in REGIONS}
        self.stack, self.count = [0], Counter()
        for m in TOKEN.finditer(html):
            if (text := m[6]) is not None:
                if self.count["head"] and not text.isspace():
                    self._end("head", 0)
                self.items.append((0, self.stack[-1], text))
            elif (tag := m[4]) is not None:
                tag = tag.lower()
                kind = 2 if tag in INLINE else 1
                if m[3]:
                    self._end(tag, m.start())
                    self.items.append((kind, self.stack[-1], tag))
                else:
                    self._start(tag, m[5], kind)

    def _pop(self, at: int) -> None:
        for e in self.stack[at:]:
            self.count[self.tag[e]] -= 1
        del self.stack[at:]

    def _start(self, tag: str, attributes: str, kind: int) -> None:
        if self.count["head"] and tag not in IN_HEAD:
            self._end("head", 0)
        while ends := [e for e in ENDS.get(tag, ()) if self.count[e]]:
            at = len(self.stack) - 1
            while at and ends and (own := self.tag[self.stack[at]]) not in ends:
                ends = [e for e in ends if own not in WITHIN[e]]
                at -= 1
            if not at or not ends:
                break
            self.closed[self.stack[at]] = True
            self._pop(at)
        self.items.append((kind, self.stack[-1], tag))
        if tag in VOID or (attributes[-1:] == "/" and ("=" not in attributes or attributes[-2:-1] in " \"'")):
            return
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.closed.append(False)
        self.stack.append(len(self.tag) - 1)
        self.count[tag] += 1

    def _end(self, tag: str, place: int) -> None:
        if not self.count[tag]:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            own = self.tag[self.stack[at]]
            if own == tag:
                self.closed[self.stack[at]] = True
                if tag in INLINE:  # blocks that started inside it stay open
                    del self.stack[at]
                    self.count[tag] -= 1
                else:
                    self._pop(at)
                return
            if tag not in FAR and tag != "head" and (own in _CELLS or (own in REGIONS and self.last[own] > place) or (tag == "li" and own in WITHIN["li"])):
                return


def scored(page: Page, model: Model) -> tuple[list[float], list[float], list[bool]]:
    """Score of each item, and of each element the evidence against its words and whether a named article holds it."""
    n = len(page.tag)
    parent, tags = page.parent, page.tag
    own = [model.names(a) if a else (0.0, 0.0, False) for a in page.attributes]
    region = [tags[i] in REGIONS and own[i][0] > -1 and own[i][1] > -1 for i in range(n)]
    holds, sections = region.copy(), [t in REGIONS or t in ("h1", "nav", "header", "footer") for t in tags]
    for i in range(n - 1, 0, -1):
        if parent[i]:
            holds[parent[i]] = holds[parent[i]] or holds[i]
            sections[parent[i]] = sections[parent[i]] or sections[i]
    words = [len(text.split()) if kind == 0 else 0 for kind, _, text in page.items]
    held = [0] * n  # words of an element; of the whole page in held[0], but for those that are never shown
    for (_, at, _), k in zip(page.items, words, strict=True):
        held[at] += k
    for i in range(n - 1, 0, -1):
        if tags[i] not in UNSEEN:
            held[parent[i]] += held[i]
    # Hard evidence comes from elements, soft evidence from names and from elements that were never closed.
    hard, soft, inside, nested, heads = [0.0] * n, [0.0] * n, [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        up, tag = parent[i], tags[i]
        heads[i] = heads[up] or tag in HEADINGS  # a heading alone does not tell which words are free of evidence
        inside[i] = inside[up] or region[i]
        nested[i] = nested[up] or tag == "article"
        element = 0.0 if tag == "header" and inside[up] else model.element(tag)
        if tag == "form" and (sections[i] or held[i] >= WRAPPED * held[0] > 0):
            element = 0.0  # a form around the page's sections or nearly all of its words is a wrapper
        strong, weak, header = (0.0, 0.0, False) if tag in ("html", "body") else own[i]
        if header and not inside[up] and not holds[i]:
            strong = min(strong, weight("strong"))
        if tag == "article" and nested[up]:
            weak = min(weak, weight("weak"))  # by the standard, an article within an article is a comment on it
        if page.closed[i] or tag == "head":
            hard[i] = hard[up] + element
        else:
            hard[i], strong = hard[up], strong + element
        soft[i] = soft[up] + strong + (0.0 if holds[i] and not region[i] else weak)
    by: Counter = Counter()
    for (_, at, _), k in zip(page.items, words, strict=True):
        if k and hard[at] > -1 and not heads[at]:
            by[soft[at]] += k
    level, so_far, total = 0.0, 0, sum(by.values())
    for value in sorted(by, reverse=True):
        level, so_far = value, so_far + by[value]
        if so_far >= LEVEL * total:
            break
    if any(region) and not any(k and holder for k, holder in zip(words, (inside[at] for _, at, _ in page.items), strict=True)):
        level = 0.0  # the page names its article, which has no words
    within = [False] * n
    for i in range(1, n):
        within[i] = within[parent[i]] or (region[i] and held[i] > 0 and hard[i] > -1 and soft[i] - level > -1)
    outside = model.outside() if any(within) else 0.0
    against = [hard[i] + min(0.0, soft[i] - level) + (0.0 if within[i] else outside) for i in range(n)]
    word = [max(0.0 if w else SKIPPED, 1.0 + e) for e, w in zip(against, within, strict=True)]
    costs: dict[tuple[bool, str], float] = {}
    scores = []
    for (kind, at, text), k in zip(page.items, words, strict=True):
        if kind == 0:
            scores.append(k * word[at])
        elif word[at] <= 0:
            scores.append(word[at])
        else:
            key = (within[at], text)
            if key not in costs:
                costs[key] = model.tag(*key)
            scores.append(costs[key])
    return scores, against, within


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, last) of the contiguous scores with the largest sum; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(html: str, model: Model) -> str:
    page = Page(html)
    scores, _, _ = scored(page, model)
    first, last = best_region(scores)
    out = []
    for (kind, _, text), score in zip(page.items[first:last], scores[first:last], strict=True):
        if kind == 1:
            out.append(" ")
        elif kind == 0 and (score > 0 or text.isspace()):
            out.append(unescape(text))
    return " ".join("".join(out).split())


def _evidence(html: str, model: Model) -> list[tuple[str, bool, str, int, int]]:
    """(kind, inside, feature, content, other) of a labelled page: words of names and elements, occurrences of tags."""
    page = Page(html)
    scores, against, within = scored(page, model)
    if not any(within):
        return []
    n, found = len(page.tag), []
    content, other, around = [0] * n, [0] * n, within.copy()
    for (kind, at, text), score in zip(page.items, scores, strict=True):
        if kind == 0 and (k := len(text.split())):
            (content if score > 0 else other)[at] += k
        elif kind:
            good = against[at] > -1
            found.append(("tag", within[at], text, int(good), int(not good)))
            if within[at] and good:  # elsewhere a tag is judged by content against all that is around it
                found.append(("tag", False, text, 1, 0))
    found.append(("word", False, "outside", 0, sum(o for o, w in zip(other, within, strict=True) if not w)))
    article = sum(c + o for c, o, w in zip(content, other, within, strict=True) if w)
    for i in range(n - 1, 0, -1):
        content[page.parent[i]] += content[i]
        other[page.parent[i]] += other[i]
        around[page.parent[i]] = around[page.parent[i]] or around[i]
    for i in range(1, n):
        up = page.parent[i]
        wrapper = around[i] and not within[i]
        explained = against[up] <= -1 and not (up == 0 or not within[up] and against[up] > DEEPEST - 1)
        if wrapper or explained or not content[i] + other[i]:
            continue
        if page.tag[i] in ELEMENTS and not (page.tag[i] == "header" and within[i]):
            found.append(("word", False, f"element {page.tag[i]}", content[i], other[i]))
        bulk = within[i] and content[i] + other[i] >= BULK * article
        for name in set(names_of(page.attributes[i])):
            good = bulk and not REMARKS & {p.lower() for p in PARTS.findall(name)}
            found.append(("word", False, f"name {name.lower()}", content[i] + other[i] if good else content[i], 0 if good else other[i]))
    return found


def fit(df: DataFrame, html_col: str = "html", most: int = MODEL_NAMES) -> Model:
    """Weights from every labelled page of ``df``, counted in Spark; at most ``most`` names come to the driver.

    A labelled page's words are content inside its article and outside what the prior knows as boilerplate. Elements
    around the article say nothing, nor do elements inside ones already known. An element that holds most of its
    article is content even where the prior takes its name for boilerplate, so labelled pages can outvote the prior.
    """
    kinds = "kind string, inside boolean, feature string, content long, other long, pages long"

    def run(batches):
        prior = Model()
        for batch in batches:
            for part in pieces(batch, "__html", 4 << 20):
                sums: dict[tuple[str, bool, str], list[int]] = {}
                for html in part.column("__html").to_pylist():
                    mine: dict[tuple[str, bool, str], list[int]] = {}
                    for kind, inside, feature, content, other in _evidence(html or "", prior):
                        at = mine.setdefault((kind, inside, feature), [0, 0])
                        at[0] += content
                        at[1] += other
                    for key, (content, other) in mine.items():
                        at = sums.setdefault(key, [0, 0, 0])
                        at[0] += content
                        at[1] += other
                        at[2] += 1
                rows = [(*k, *v) for k, v in sums.items()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                types = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [k.split()[0] for k in kinds.split(", ")])
        give_back()

    sums = df.select(F.col(html_col).cast("string").alias("__html")).mapInArrow(run, kinds).groupBy("kind", "inside", "feature")
    sums = sums.agg(F.sum("content").alias("content"), F.sum("other").alias("other"), F.sum("pages").alias("pages"))
    parts = F.regexp_extract_all(F.lower("feature"), F.lit("[a-z]+"), 0)
    told = (F.col("content") < F.col("other")) | F.arrays_overlap(parts, F.array(*[F.lit(x) for x in sorted(SIGNS)]))  # names of which the prior says something
    some = sums.filter((F.col("pages") >= LEAST_PAGES) & ((F.col("kind") == "tag") | told))
    words, tags = {}, {}
    for r in some.orderBy(F.desc(F.col("content") + F.col("other")), "kind", "inside", "feature").limit(most).collect():
        if r["kind"] == "tag":
            tags[r["inside"], r["feature"]] = tag_weight(r["inside"], r["feature"], r["content"], r["other"])
        else:
            what, _, name = r["feature"].partition(" ")
            known = sign(name) if what == "name" else "strong"
            words[r["feature"]] = weight("none" if known == "header" else known, r["content"], r["other"])
    return Model(words, tags)


def extract(df: DataFrame, model: Model, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and its ``n_chars``."""
    keep = tuple(k for k in keep if k not in ("text", "n_chars"))
    words, tags = model.words, model.tags

    def run(batch: pa.RecordBatch) -> dict:
        own = Model(words, tags)
        texts = [main_text(h or "", own) for h in batch.column("__html").to_pylist()]
        return {k: batch.column(k) for k in keep} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    own = df.select(*keep, df[html_col].cast("string").alias("__html"))
    kinds = ddl(own, "__html")
    return map_texts(own, run, kinds + "text string, n_chars long", "__html")


def op3(spark, sf_dir):
    """Main text of every page, with weights learnt from the labelled pages among them."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return extract(pages, fit(pages))
