"""Main text of web pages by the maximum-scoring subsequence.

A page is read once as a sequence of tags and words. Words score positive and tags negative; the scores are log-odds of
being inside the main content, counted on labelled pages. A linear scan finds the contiguous run with the largest sum,
which is then widened to the bounds of the content element it lies in.

Containers named as boilerplate (by element, role, class or id) are no islands cut out beforehand: each costs its score
once, whatever is in it, and its words add nothing. A name says nothing where too little of the page would be left
without the container (a form or a widget around the whole page), and one that never ends covers its first block only.

Bounds: where the run touches ``article`` elements, these and their siblings of that name belong to the region from end
to end, likewise ``main``; words outside of all of them score negative and don't come along. On other pages the region is
the run, widened to the deepest element that holds most of its words, without link lists that the run leaves out.

Labelled pages are those with exactly one ``article`` or ``main`` element: it is the content, the rest is not. ``fit``
takes about ``SAMPLE`` of them (those with small hashes of the html); without any, ``DEFAULT`` holds.

Defined results: null or empty html gives the empty text; a page without words gives the empty text; white space inside
a block (line breaks too) becomes one space; repeated pages are treated alike; a tie between runs goes to the first.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import sliced, text_column

#: Labelled pages that weights are fitted on, about.
SAMPLE = 2000
#: A boilerplate name counts only where this share of the content's words is left without the containers so named.
LEFT = 0.1
#: The run is widened to the deepest element with this share of its words.
MOST_OF_RUN = 0.8

# HTML elements, and the words in class, id and role that mark boilerplate.
SKIPPED = set("nav footer aside form noscript head title button select dialog menu template iframe svg object canvas audio video map".split())
RAW = "script style textarea title iframe noembed noframes xmp"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var td th".split())
OPTIONAL_END = set("p li dt dd td th tr tbody thead tfoot option".split())
MAIN = {"article", "main"}
MARKED = set(
    "ad ads adsense advert adverts advertisement advertorial banner breadcrumb breadcrumbs comment comments commentlist respond disqus consent cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
NOT_MARKED_WITH = {"page", "layout", "main"}
NOT_MARKED_AFTER = {"with", "without", "has", "no", "is", "not"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

KNOWN = SKIPPED | VOID | BLOCKS | INLINE
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>" + RAW.replace(" ", "|") + r")(?=[\s/>]).*?(?:</(?P=raw)[^>]*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Scores if no page is labelled: of words by their place, of tags, and of a boilerplate container.
DEFAULT = {"word": 1.0, "linked": 0.2, "outside": -1.0, "container": -4.0, "p": -0.1, "br": -0.1, "b": -0.1, "i": -0.1, "em": -0.1, "strong": -0.1, "other": -1.0}
LEAST, MOST = 0.1, 4.0


def named_boilerplate(name: str, attrs: str, inside: bool) -> bool:
    """Whether element, role, class or id name a container as boilerplate; ``inside``: of an article or main element."""
    if name in ("html", "body", "main"):
        return False
    if name in SKIPPED or name == "header" and not inside:
        return True
    if not attrs or attrs.isspace():
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            for one in value.split():
                parts = re.findall(r"[a-z0-9]+", one)
                if parts and parts[0] not in NOT_MARKED_AFTER and not NOT_MARKED_WITH & set(parts) and (set(parts) & MARKED or "header" in parts and not inside):
                    return True
    return False


@dataclass
class Element:
    name: str
    begin: int
    parent: int
    named: bool = False
    inside: bool = False
    end: int = -1
    closed: bool = False


@dataclass
class Page:
    """Tokens of a page: a tag's name or None for text, the text or None for tags, whether it is linked, and its element."""

    names: list[str | None] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def read(page: str) -> Page:
    """The tokens and elements of a page. End tags without a start are tags of their own; missing ones end with the
    parent, those of paragraphs, items and cells with the next one."""
    out = Page()
    stack: list[int] = []
    count: Counter = Counter()
    links = main = 0

    def pop(closed: bool) -> None:
        nonlocal links, main
        e = out.elements[stack.pop()]
        e.end, e.closed = len(out.names), closed or e.name in OPTIONAL_END
        count[e.name] -= 1
        links -= e.name == "a"
        main -= e.name in MAIN

    def token(name: str | None, text: str | None) -> None:
        out.names.append(name), out.texts.append(text), out.linked.append(links > 0), out.owner.append(stack[-1] if stack else -1)

    for m in _TOKEN.finditer(page):
        if m["text"]:
            token(None, m["text"])
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            token(name, None)
            if count[name] > 0:
                while out.elements[stack[-1]].name != name:
                    pop(False)
                pop(True)
            continue
        if name in BLOCKS and count["p"] and name not in ("html", "body"):
            while stack and (top := out.elements[stack[-1]].name) in INLINE:
                pop(False)
            if stack and out.elements[stack[-1]].name == "p":
                pop(True)
        if name in OPTIONAL_END and count[name]:
            while stack and out.elements[stack[-1]].name in INLINE - {name}:
                pop(False)
            if stack and out.elements[stack[-1]].name == name:
                pop(True)
        if name == "a" and count["a"]:
            while stack and out.elements[stack[-1]].name in INLINE - {"a", "td", "th"}:
                pop(False)
            if stack and out.elements[stack[-1]].name == "a":
                pop(True)
        if name not in VOID and not m["attrs"].rstrip().endswith("/"):
            out.elements.append(Element(name, len(out.names), stack[-1] if stack else -1, named_boilerplate(name, m["attrs"], main > 0), main > 0))
            stack.append(len(out.elements) - 1)
            count[name] += 1
            links += name == "a"
            main += name in MAIN
        token(name, None)
    while stack:
        pop(False)
    return out


def containers(page: Page, words: list[int], counted: list[bool]) -> list[tuple[int, int]]:
    """(begin, end) of the boilerplate containers whose names count, outermost ones, in order. ``words``: of each token;
    ``counted``: tokens that may be content."""
    named = [e for e in page.elements if e.named]
    if not named:
        return []
    blocks = [t for t, name in enumerate(page.names) if name in BLOCKS]
    spans = []
    for e in named:
        following = bisect_right(blocks, e.begin)
        first = blocks[following] if following < len(blocks) else e.end
        spans.append((e.begin, e.end if e.closed else min(first, e.end)))
    # The words of each container outside of those in it; spans are nested or apart, in order of their begins.
    own, parent, stack, at, free = [0] * len(spans), [-1] * len(spans), [], 0, 0
    for t, n in enumerate(words):
        while stack and spans[stack[-1]][1] <= t:
            stack.pop()
        while at < len(spans) and spans[at][0] <= t:
            if spans[at][1] > t:
                parent[at] = stack[-1] if stack else -1
                stack.append(at)
            at += 1
        if n and counted[t]:
            if stack:
                own[stack[-1]] += n
            else:
                free += n
    total, ignored = free + sum(own), set()
    for best in sorted(range(len(spans)), key=lambda s: (-own[s], s)):
        if free >= LEFT * total:
            break
        while best >= 0 and best not in ignored:
            ignored.add(best)
            free += own[best]
            best = parent[best]
    out: list[tuple[int, int]] = []
    for s, (begin, end) in enumerate(spans):
        if s not in ignored and (not out or begin >= out[-1][1]):
            out.append((begin, end))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the largest sum; (0, 0) if no sum is positive."""
    best, at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, at = total, (begin, i + 1)
    return at


class Scored:
    """A page with the score of each token, and which tokens are in boilerplate containers or outside the content."""

    def __init__(self, html_text: str, scores: dict[str, float]):
        self.page = page = read(html_text)
        n = len(page.names)
        self.words = [len(t.split()) if t is not None else 0 for t in page.texts]
        within = [False] * n
        for e in page.elements:
            if e.name in MAIN and not e.inside and not e.named:
                within[e.begin : e.end] = [True] * (e.end - e.begin)
        self.has_main = any(within)
        self.counted = within if self.has_main else [True] * n
        self.spans = containers(page, self.words, self.counted)
        self.dropped = [False] * n
        self.scores = [0.0] * n
        other = scores["other"]
        for t, (name, linked) in enumerate(zip(page.names, page.linked, strict=True)):
            if name is not None:
                self.scores[t] = scores.get(name, other)
            elif self.words[t]:
                self.scores[t] = self.words[t] * (scores["outside"] if not self.counted[t] else scores["linked" if linked else "word"])
        for begin, end in self.spans:
            self.dropped[begin:end] = [True] * (end - begin)
            self.scores[begin:end] = [scores["container"]] + [0.0] * (end - begin - 1)

    def region(self) -> tuple[int, int]:
        """The best run, widened to the content elements it touches or the element that holds most of it."""
        begin, end = best_run(self.scores)
        if begin == end:
            return begin, end
        elements = self.page.elements
        if self.has_main:
            touched = [e for e in elements if e.name == "article" and not e.named and not self.dropped[e.begin] and e.begin < end and e.end > begin]
            parents = {e.parent for e in touched}
            found = [e for e in elements if e.name == "article" and not e.named and not self.dropped[e.begin] and e.parent in parents]
            found = found or [e for e in elements if e.name == "main" and e.begin < end and e.end > begin]
            return min([begin, *(e.begin for e in found)]), max([end, *(e.end for e in found)])
        upto = [0]
        for n, gone in zip(self.words, self.dropped, strict=True):
            upto.append(upto[-1] + (0 if gone else n))
        whole = upto[end] - upto[begin]
        holder, own = None, -1
        for i, e in enumerate(elements):  # parents come before their children
            if e.begin < end and e.end > begin and upto[min(end, e.end)] - upto[max(begin, e.begin)] >= MOST_OF_RUN * whole:
                holder, own = e, i
        if holder is not None and holder.name not in ("html", "body"):
            links = [0]
            for n, gone, linked in zip(self.words, self.dropped, self.page.linked, strict=True):
                links.append(links[-1] + (n if linked and not gone else 0))
            for e in elements:
                outside = e.parent == own and (e.end <= begin or e.begin >= end)
                if outside and 2 * (links[e.end] - links[e.begin]) > upto[e.end] - upto[e.begin]:
                    self.dropped[e.begin : e.end] = [True] * (e.end - e.begin)
            begin, end = min(begin, holder.begin), max(end, holder.end)
        return begin, end

    def text(self) -> str:
        begin, end = self.region()
        blocks: list[list[str]] = [[]]
        for t in range(begin, end):
            name, text = self.page.names[t], self.page.texts[t]
            if name in BLOCKS or name in SKIPPED:
                blocks.append([])
            elif self.dropped[t]:
                blocks[-1].append(" ")
            elif name in ("br", "td", "th"):
                blocks[-1].append(" ")
            elif text is not None and self.counted[t]:
                blocks[-1].append(text)
        # A reference may be cut by nothing but a tag, so each text run is decoded by itself.
        lines = (" ".join("".join(map(html.unescape, b)).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def extract(page: str, scores: dict[str, float]) -> str:
    return Scored(page, scores).text()


def counted(html_text: str) -> Counter | None:
    """Features inside and outside of the only article or main element; None for a page without a label."""
    if len(re.findall(r"<(?:article|main)[\s>]", html_text, re.I)) != 1:
        return None
    page = read(html_text)
    label = next((e for e in page.elements if e.name in MAIN), None)
    if label is None:
        return None
    found: Counter = Counter()
    for t, (name, text) in enumerate(zip(page.names, page.texts, strict=True)):
        inside = label.begin < t < label.end
        if name is not None:
            found[name if name in KNOWN else "other", inside] += name not in MAIN
        else:
            n = len(text.split())
            found["linked" if page.linked[t] else "word", inside] += n
            found["outside", False] += 0 if inside else n
    for e in page.elements:
        if e.named:
            found["container", label.begin < e.begin < label.end] += 1
    return found


def fit(pages: DataFrame, column: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Scores from about ``sample`` labelled pages; what reaches the driver is a count for each element of HTML."""
    labelled = pages.select(F.col(column).cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    n = labelled.count()
    some = labelled.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < (sample << 20) // max(n, 1) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(counted(page) or {})
        keys = list(total)
        yield pa.RecordBatch.from_pydict({"feature": [k[0] for k in keys], "inside": [k[1] for k in keys], "n": [total[k] for k in keys]})

    sums = some.mapInArrow(run, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    return weights({(r["feature"], r["inside"]): r["n"] for r in sums.collect()})


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of each feature to be inside, words held between LEAST and MOST, the rest between their negatives."""
    if not any(n for (_, inside), n in counts.items() if inside):
        return dict(DEFAULT)
    names = {f for f, _ in counts} | set(DEFAULT)
    total = {side: sum(n for (f, inside), n in counts.items() if inside is side and f != "outside") + len(names) for side in (True, False)}
    odds = {f: math.log((counts.get((f, True), 0) + 1) / total[True]) - math.log((counts.get((f, False), 0) + 1) / total[False]) for f in names}
    out = {f: -min(max(-v, LEAST), MOST) for f, v in odds.items() if f not in ("word", "linked")}
    for kind in ("word", "linked"):
        out[kind] = min(max(odds[kind], LEAST), MOST)
    # A name nobody has met says nothing against content.
    out["other"] = max(out["other"], DEFAULT["other"])
    return out


def main_text(df: DataFrame, scores: dict[str, float], column: str = "html", text: str = "text") -> DataFrame:
    """``df`` with the main text of ``column`` in ``text`` (a column of that name is replaced) in place of the html."""
    base = df.drop(text) if text != column else df
    kept = [f for f in base.schema.fields if f.name != column]
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column):
            texts = [extract(p, scores) for p in text_column(batch, column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), text])

    return base.mapInArrow(run, StructType([*kept, StructField(text, StringType())]))


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with scores fitted on labelled pages of the same table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
