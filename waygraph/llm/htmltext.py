"""Main text of web pages by the maximum-scoring subsequence of words and tags.

Words score positive, tags negative. How much comes from labelled pages: those that mark
their content with <article> or <main> say which words and tags lie inside it, a word by
the element around it, a tag by its name, class, id and role. One scan finds the contiguous
run of greatest score; that is the content. The smallest element around the run completes
it at its edges. Inside, elements that are never content (menus, forms and the like) go,
and those whose class, id or role was learned to lie outside; a class that no labelled page
has is judged by whether its words are usual for such parts (``OUT_WORDS``), with what was
learned about those.

Fitting takes at most ``TRAIN_PAGES`` pages (those of least hash) and ``TAG_KINDS`` kinds
of tag; extraction covers every page whole.

Edge cases: a null or empty html, and one without words, gives an empty text; unclosed
elements, comments and attributes end with the page; repeated rows give equal rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.llm.common import only

TRAIN_PAGES, TAG_KINDS = 500, 6000
WORD, TAG, OUTER = 1.0, -3.25, 0.02  # where nothing is learned; the least that a word scores

TAG_END = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
KEY = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript", "template"}
CLOSE = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}
CONTENT = {"article", "main"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "col", "area", "base", "embed", "track", "param"}
#: Elements that are kept on the stack; the rest only break blocks or do nothing.
HOLD = {"html", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "blockquote", "figure", "details", "fieldset", "center", "menu", "dialog", "select", "button", "svg", "object", "video", "audio", "canvas", "head"}
BREAK = HOLD | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "pre", "hr", "address", "figcaption", "summary", "legend", "option", "title", "hgroup"}
NEVER = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "svg", "object", "video", "audio", "canvas", "fieldset", "head"}
OUT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|notification\w*|alerts?|popup\w*|modal|overlay|newsletter\w*|subscri\w*|signup"
    r"|comments?|commentlist|respond|repl(?:y|ies)|discuss\w*|disqus\w*|sidebar\w*|side-?bar|menu\w*|nav(?:bar|igation)?|breadcrumbs?|toolbar|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*"
    r"|footer\w*|masthead|site-?header|pagination|pager|login|complementary|contentinfo)(?=$|[\s_-])",
    re.I,
)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, open, close; comments and raw elements are left out."""
    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        name = NAME.match(page, lt + 1)
        if not name:
            if page[lt + 1 : lt + 2] in "!?/":
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        if lt > last:  # the page ends within a tag
            return
        end = TAG_END.match(page, name.end())
        stop = end.end() if end else page.find(">", name.end()) + 1
        rest, tag = page[name.end() : stop - 1], name[0].lower()
        at = stop
        if tag[0] == "/":
            yield "close", tag[1:], ""
            continue
        yield "open", tag, rest
        if tag in RAW and not rest.endswith("/"):
            shut = CLOSE[tag].search(page, at)
            at = shut.start() if shut else n


def labels(rest: str) -> str:
    """A tag's class, id and role."""
    return " ".join(filter(None, (x for m in KEY.findall(rest) for x in m))).lower()


def mark(name: str, rest: str) -> str:
    """What a tag is scored as: its name with the start of its class, id and role."""
    keys = labels(rest)
    return f"{name} {keys}"[:80] if keys else name


def usual(keys: str) -> str:
    """What stands for a class that no labelled page has."""
    return "~outer" if OUT_WORDS.search(" " + keys) else "~plain"


def outside(mark_: str, keys: str, weights: dict[str, float] | None) -> bool:
    """Is an element with this class, id or role no content? Before anything is learned its words say so."""
    if not keys:
        return False
    word = -1.0 if usual(keys) == "~outer" else 1.0
    if weights is None:
        return word < 0
    return weights.get(f"in|{mark_}", weights.get(f"in|{usual(keys)}", word)) < 0


class Page:
    """Blocks of text with the elements around them, and the scored sequence."""

    def __init__(self, page: str, weights: dict[str, float] | None = None):
        self.parent, self.name, self.mark, self.keys, self.out = [-1], ["#page"], ["#page"], [""], [False]
        self.blocks: list[tuple[int, str]] = []  # element, text
        self.items: list[tuple[str, int, int, int]] = []  # mark or word kind, words, block, element
        here, text, links = 0, [], 0

        def flush():
            line = " ".join(htmllib.unescape("".join(text)).split())
            if line:
                self.blocks.append((here, line))
            text.clear()

        for kind, name, rest in tokens(page):
            if kind == "text":
                words = len(rest.split())
                text.append(rest)
                if words:
                    self.items.append(("a:word" if links else "word", words, len(self.blocks), here))
                continue
            key = mark(name, rest) if kind == "open" else "/" + name
            if name in BREAK:
                flush()
            elif name == "br":
                text.append(" ")
            if name == "a":
                links = 1 if kind == "open" else 0
            if kind == "open" and name in HOLD and name not in VOID and not rest.endswith("/"):
                keys = labels(rest)
                never = name in NEVER or (name not in ("html", "body", "main") and outside(key, keys, weights))
                self.parent.append(here)
                self.name.append(name)
                self.mark.append(key)
                self.keys.append(keys)
                self.out.append(self.out[here] or never)
                here = len(self.name) - 1
            elif kind == "close" and name in HOLD:
                up = here
                while up > 0 and self.name[up] != name:
                    up = self.parent[up]
                if up > 0:
                    here = self.parent[up]
            self.items.append((key, 0, len(self.blocks), here))
        flush()

    def scored(self, weights: dict[str, float]) -> list[float]:
        tag = weights.get("#tag", TAG)
        out = []
        for key, words, _, e in self.items:
            if words:
                one = weights.get(f"{key}|{self.mark[e]}", weights.get(key, WORD))
                out.append(words * (min(one, OUTER) if self.out[e] else one))
            else:
                out.append(weights.get(key, tag))
        return out

    def above(self, e: int) -> list[int]:
        out = []
        while e >= 0:
            out.append(e)
            e = self.parent[e]
        return out

    def content(self, e: int) -> int:
        """Nearest content element around ``e`` that is none of a comment's or advert's; else -1."""
        return next((x for x in self.above(e) if self.name[x] in CONTENT and not self.out[x]), -1)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Ends of the run of greatest score, in one scan; (0, 0) if none is positive."""
    best, ends, sum_, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += score
        if sum_ > best:
            best, ends = sum_, (start, i + 1)
    return ends


def extract(page: str | None, weights: dict[str, float]) -> str:
    doc = Page(page or "", weights)
    a, b = best_run(doc.scored(weights))
    inside = sorted({min(block, len(doc.blocks) - 1) for _, words, block, _ in doc.items[a:b] if words} if doc.blocks else ())
    good = [i for i in inside if not doc.out[doc.blocks[i][0]]]
    if not good:
        return ""
    # the smallest element around what the run holds
    paths = [doc.above(doc.blocks[i][0]) for i in (good[0], good[-1])]
    other = set(paths[1])
    home = next(e for e in paths[0] if e in other)
    while doc.name[home] not in CONTENT and (up := next((e for e in doc.above(home) if doc.name[e] in CONTENT), -1)) >= 0:
        home = up  # a part of the content that outscores the rest
    if doc.name[home] in ("html", "body", "#page"):
        lines = [doc.blocks[i][1] for i in range(good[0], good[-1] + 1) if not doc.out[doc.blocks[i][0]]]
    else:
        under = [False] * len(doc.name)
        for e, up in enumerate(doc.parent):  # parents come first
            under[e] = e == home or (up >= 0 and under[up])
        lines = [t for e, t in doc.blocks if under[e] and not doc.out[e]]
    return "\n".join(lines)


def tally(page: str | None) -> Counter:
    """(mark, inside content) counts of a labelled page; nothing of an unlabelled one."""
    doc, out = Page(page or ""), Counter()
    if not any(n in CONTENT for n in doc.name):
        return out
    around = {x for e, n in enumerate(doc.name) if n in CONTENT for x in doc.above(e)}
    inner = [doc.content(e) >= 0 and not doc.out[e] for e in range(len(doc.name))]
    for key, words, _, e in doc.items:
        out[key, inner[e]] += words or 1
        if words:
            out[f"{key}|{doc.mark[e]}", inner[e]] += words
    for e, keys in enumerate(doc.keys):
        if keys:
            for key in (doc.mark[e], usual(keys)):
                out[f"in|{key}", inner[e] or e in around] += 1
    return out


def learn(pages: DataFrame, rows: int = TRAIN_PAGES, kinds: int = TAG_KINDS) -> dict[str, float]:
    """Log odds of lying inside, of words and of each kind of tag; signs are held."""
    labelled = only(pages, "page_id", "html").where(F.lower("html").rlike(r"<(?:article|main)[\s>]")).withColumn("h", F.xxhash64("page_id", "html"))
    least = labelled.select("h").distinct().orderBy("h").limit(rows)  # numbers only; so few can be broadcast
    sample = labelled.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"]).select("page_id", "html")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                total.update(tally(page))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["mark", "inside", "n"])

    counts = sample.mapInArrow(run, "mark string, inside boolean, n long").groupBy("mark").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("within"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("without")
    )
    found = counts.orderBy((F.col("within") + F.col("without")).desc(), "mark").limit(kinds).collect()
    plain = [r for r in found if "|" not in r["mark"]]
    n1, n0 = (sum(r[c] for r in plain) + 1 for c in ("within", "without"))
    out: dict[str, float] = {}
    tags = [0, 0]
    for r in found:
        key = r["mark"]
        if key.startswith("in|"):
            out[key] = math.log(r["within"] + 0.5) - math.log(r["without"] + 0.5)
            continue
        odds = math.log((r["within"] + 0.5) / n1) - math.log((r["without"] + 0.5) / n0)
        if key.split("|")[0] in ("word", "a:word"):
            out[key] = max(odds, OUTER)
        else:
            out[key] = min(odds, -0.1)
            tags[0] += r["within"]
            tags[1] += r["without"]
    if found:
        out["#tag"] = min(math.log((tags[0] + 0.5) / n1) - math.log((tags[1] + 0.5) / n0), -0.5)
    return out


def extract_pages(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            texts = [extract(p, shared.value) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return only(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_max_subsequence(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_pages(pages, learn(pages))
