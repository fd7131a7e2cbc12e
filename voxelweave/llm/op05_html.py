"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with the path of tags (and classes) from the
root to its block element. Every path gets three ratios over all of its blocks:
characters a block, punctuation marks a block, and the share of characters in
links; fused they are (characters) x (1 + marks) x (1 - links). Ratios are then
smoothed in two ways: along the tree, by what the blocks of the largest element
around a path (short of the one that holds the whole page) come to, and along
the page, by the lesser of the neighbours on both sides. A path is content if its
smoothed ratio reaches a quarter of the page's mean, weighted by characters; a
heading's blocks go with what follows them. The main text is the blocks of the
content paths, in page order; nothing else of the page enters it.

What HTML itself says is no text of the page (scripts, forms, navigation and the
like) has no blocks. What a class, id or role names as an advert, comments, a
notice and so on keeps its blocks, but its ratios count a fiftieth, unless it holds
an article, a main, or most of the page; on a page with an article or a main,
ratios outside of these count a quarter.

Defined results: null, empty or text-free html gives an empty text; unclosed
tags end where their parent ends, an unclosed comment runs to the end of the
page; pages repeat and ids may be null or tied without effect; no part of a
page is left unread, and the work grows with its length alone.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map

#: A content path reaches this share of the page's mean ratio.
THRESHOLD = 0.25
#: What a path gets from the element around it, and from its neighbours.
AROUND, BETWEEN = 0.5, 0.5
#: What the ratios of blocks count whose element is named something else.
NAMED = 0.02
#: What the ratios of blocks count outside of article and main, where a page has these.
OUTSIDE = 0.25

# Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NOT_TEXT = frozenset("head title script style noscript template nav header footer aside form button select option textarea menu dialog svg canvas iframe object audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that name something beside the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget cookie cookies consent gdpr popup modal overlay comment comments reply replies disqus "
    "share sharing social newsletter subscribe subscription signup login related recommended pagination pager toolbar search contentinfo complementary".split()
)
# Words that an article's own parts may have as well; they count only beside one of NAMES.
BESIDE = frozenset("notice alert discussion site page top bottom left right bar box list section block container wrapper area".split())
_TAG = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)""")
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*["']?\s*([^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""\b(?:hidden(?=[\s/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class _Element:
    """``path`` is a number that elements of like paths share."""

    __slots__ = ("tag", "parent", "path", "out", "named", "link", "block", "holds", "prior", "mass", "total", "around", "inside")

    def __init__(self, tag, parent, path, out=False, named=False):
        self.tag, self.parent, self.path, self.out, self.named = tag, parent, path, out, named
        self.link = tag == "a" or parent is not None and parent.link
        self.block = parent.block if tag in INLINE else self
        self.holds, self.prior, self.mass, self.total, self.around, self.inside = False, 1.0, 0.0, 0.0, 0.0, False


class _Block:
    __slots__ = ("element", "parts", "linked", "text", "own", "value", "prior")

    def __init__(self, element):
        self.element, self.parts, self.linked, self.own, self.value, self.prior = element, [], 0, 0.0, 0.0, 1.0


def _hidden(tag: str, attributes: str) -> bool:
    if tag in NOT_TEXT:
        return True
    if tag in ("html", "body", "main", "article") or not attributes:
        return False
    return bool(_HIDDEN.search(attributes))


def _named(attributes: str) -> bool:
    """Whether a whole class, id or role consists of NAMES, with BESIDE words."""
    for m in _NAME.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            words = set(_WORDS.findall(token))
            if words & NAMES and words <= NAMES | BESIDE:
                return True
    return False


def blocks(page: str) -> tuple[list[_Block], list[_Element]]:
    """The blocks of text in page order and all elements, parents first."""
    paths: dict[tuple, int] = {}
    root = _Element("", None, 0)
    stack, made, open_ = [root], [root], {}
    out: list[_Block] = []
    at, n, fresh, quotes = 0, len(page), True, True

    def pop() -> None:
        open_[stack.pop().tag] -= 1

    while at < n:
        m = _TAG.search(page, at)
        attributes, stop = "", 0
        if m and m[0] != "<!--":
            found = _ATTRIBUTES.match(page, m.end()) if m[2] and quotes else None
            # after a quote that is never closed, tags end at the next ">"
            quotes = quotes and (found is not None or not m[2])
            stop = found.end() if found else page.find(">", m.end())
            if stop < 0:
                m = None
            else:
                attributes = page[m.end() : stop]
        end = m.start() if m else n
        here = stack[-1]
        if end > at and not here.out:
            if fresh:
                out.append(_Block(here.block))
            text = html.unescape(page[at:end])
            out[-1].parts.append(text)
            if here.link:
                out[-1].linked += len(text.strip())
            fresh = False
        if not m:
            break
        if m[0] == "<!--":
            stop = page.find("-->", m.end())
            at = n if stop < 0 else stop + 3
            continue
        at = stop + 1
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            fresh = True
        if m[1]:
            if open_.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        close = ("p",) if tag in _CLOSES_P else _SAME.get(tag, ())
        if any(open_.get(c) for c in close):
            up, found = len(stack) - 1, 0
            while up and (stack[up].tag in INLINE or stack[up].tag in close):
                found = up if stack[up].tag in close else found
                up -= 1
            while found and len(stack) > found:
                pop()
        if tag in VOID or attributes.endswith("/") and tag not in RAW:
            continue
        here = stack[-1]
        label = _CLASS.search(attributes) if attributes and tag not in INLINE else None
        named = bool(attributes) and _named(attributes)
        step = (here.path, tag, label[1].lower() if label else "", named)
        e = _Element(tag, here, paths.setdefault(step, len(paths) + 1), here.out or _hidden(tag, attributes), named)
        made.append(e)
        stack.append(e)
        open_[tag] = open_.get(tag, 0) + 1
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else n
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text], made


def _priors(found: list[_Block], made: list[_Element]) -> None:
    """Marks the elements whose names say that they are something else."""
    for b in found:
        b.element.mass += len(b.text)
    total, marked = float(sum(len(b.text) for b in found)), False
    for e in reversed(made):
        if e.parent is not None and not e.out:
            e.parent.mass += e.mass
            e.parent.holds |= e.holds or e.tag in ("article", "main") and not e.named and e.mass > 0
            marked = marked or e.parent.holds
    for e in made[1:]:
        own = e.named and e.tag not in ("html", "body", "main", "article") and not e.holds and (marked or 2 * e.mass <= total)
        e.inside = e.parent.inside or e.tag in ("article", "main") and not e.named
        e.prior = min(e.parent.prior, NAMED if own else 1.0)
    for b in found:
        b.prior = b.element.prior * (OUTSIDE if marked and not b.element.inside else 1.0)


def ratios(found: list[_Block], made: list[_Element]) -> dict[int, float]:
    """The smoothed ratio of every path; blocks get theirs as ``value``."""
    _priors(found, made)
    sums: dict[int, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.element.path, [0.0, 0.0, 0.0, 0.0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(_MARKS.findall(b.text))
        s[3] += min(b.linked, len(b.text))
    plain = {p: 1 - linked / chars for p, (_, chars, _, linked) in sums.items()}
    fused = {p: chars / k * (1 + marks / k) * plain[p] for p, (k, chars, marks, _) in sums.items()}
    for b in found:
        b.own = fused[b.element.path] * b.prior
        b.element.total += b.own * len(b.text)
    for e in reversed(made):
        if e.parent is not None:
            e.parent.total += e.total
    # the best mean of an element around a block that does not hold the whole page
    whole = made[0].mass
    for e in made[1:]:
        inside = e.mass < whole or e.tag in ("article", "main")
        e.around = max(e.parent.around, e.total / e.mass if e.mass and inside else 0.0)
    value, times = {}, {}
    n = len(found)
    for i, b in enumerate(found):
        between = min(found[i - 1].own, found[i + 1].own) if 0 < i < n - 1 else 0.0
        p = b.element.path
        best = max(b.own, max(AROUND * b.element.parent.around if b.element.parent else 0.0, BETWEEN * between) * plain[p] * b.prior)
        value[p] = value.get(p, 0.0) + best
        times[p] = times.get(p, 0) + 1
    value = {p: v / times[p] for p, v in value.items()}
    for b in found:
        b.value = value[b.element.path]
    return value


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    found, made = blocks(page or "")
    if not found:
        return ""
    ratios(found, made)
    mean = made[0].total / sum(len(b.text) * b.prior for b in found)
    content, follows = [False] * len(found), False
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if b.element.tag in HEADING:
            content[i] = follows and b.element.prior == 1.0 or b.own >= threshold * mean
        else:
            follows = content[i] = b.value >= threshold * mean
    return " ".join(b.text for b, c in zip(found, content) if c)


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    kinds = dict(pages.dtypes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").transform(arrow_map, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op5_tag_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
