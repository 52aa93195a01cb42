"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a line of words and tags. Each kind of item has a weight, the log odds of standing inside the main
content, counted on labelled pages: those whose own markup names the content (article or main), in a bounded sample.
Words of running text weigh positive; tags, links, words beside named content and furniture (menus, notices, comments
...) negative. One linear scan finds the contiguous region with the largest sum; its words without furniture are the
text. On pages without named content a word weighs by its place instead: the log odds of its block element, linked or
not, plus those of the class, id and role words of the innermost element that has any, all counted on the labelled
pages; where no place weighs positive, plain words do.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reverbtable.llm.book import query, table

MAX_LABELLED = 2_000  # pages that weights are counted on
MAX_NAMES = 1_000     # class, id and role words that get a weight, the most frequent ones of the labelled pages

# fixed values: element names
CONTENT = {"article", "main"}
DROPPED = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "select", "textarea", "title"}
FURNITURE = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "button", "fieldset", "head"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details",
          "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1",
          "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav",
          "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th",
          "thead", "tr", "ul"}
PLACES = BLOCKS - CONTENT - {"html"}  # elements whose name places a word
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# fixed values: words in class, id or role that name furniture
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "breadcrumb",
         "breadcrumbs", "comment", "comments", "commentlist", "consent", "contentinfo", "cookie", "cookies", "disqus",
         "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay",
         "pagination", "popup", "promo", "promoted", "reactions", "related", "replies", "respond", "search", "share",
         "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
         "alert", "complementary", "disclaimer", "masthead", "topbar", "copyright"}
# fixed values: furniture that may itself hold articles
HOLDERS = {"aside", "dialog", "comment", "comments", "commentlist", "complementary", "disqus", "promoted", "related",
           "replies", "respond", "sidebar", "widget"}

_RAW = re.compile("<(" + "|".join(sorted(DROPPED)) + r")\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in DROPPED}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile("[\"'>]")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_CONTENT = re.compile(r"<(?:article|main)[\s>]", re.I)
_SPACE = re.compile(r"\s+")


def _names(attrs: str) -> frozenset[str]:
    """Words of class, id and role."""
    return frozenset(n for value in _NAMED.findall(attrs) for n in re.split(r"[^a-z0-9]+", value.lower()) if n) if attrs else frozenset()


def _furniture(tag: str, attrs: str, names: frozenset[str], in_content: bool) -> int:
    """0: none, 1: furniture, 2: furniture that may itself hold articles, as comments do."""
    if tag in HOLDERS or names & HOLDERS:
        return 2 if tag not in ("html", "body", "main") else 0
    if tag in ("html", "body", *CONTENT):
        return 0
    if tag in FURNITURE and not (in_content and tag == "header"):
        return 1
    return int(bool(names & NAMES) or bool(attrs and _HIDDEN.search(attrs)))


class _Ends:
    """Where tags of a page end: at the first > outside quotes or, where a quote is never closed, at the first >.

    What follows a quote is the same from whichever tag it is met, so it is found once per quote, and a stretch without
    quotes and > is searched once: all tags of a page together cost one pass.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.after: dict[int, int] = {}  # quote to the end of a tag that holds it, -1 if a quote is never closed
        self.seen, self.next = 0, -1     # from seen on, the next mark is at next

    def mark(self, at: int) -> int:
        if not self.seen <= at <= self.next:
            found = _MARK.search(self.page, at)
            self.seen, self.next = at, found.start() if found else len(self.page)
        return self.next

    def end(self, at: int) -> tuple[int, bool]:
        """The > that ends a tag whose name ends at `at`, or -1, and whether its quotes are closed."""
        if at > self.last:
            return -1, False
        met, k = [], self.mark(at)
        while True:
            if k == len(self.page):
                found = -1
            elif self.page[k] == ">":
                found = k
            elif k in self.after:
                found = self.after[k]
            else:
                met.append(k)
                close = self.page.find(self.page[k], k + 1)
                if close >= 0:
                    nearest = _MARK.search(self.page, close + 1)
                    k = nearest.start() if nearest else len(self.page)
                    continue
                found = -1
            break
        for quote in met:
            self.after[quote] = found
        return (found, True) if found >= 0 else (self.page.find(">", at), False)


def _parts(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, tag, attributes, text) in page order: text, raw (an element whose content is left out), open, end."""
    ends, at, size = _Ends(page), 0, len(page)
    while at < size:
        if page[at] != "<":
            to = page.find("<", at)
            to = size if to < 0 else to
            yield "text", "", "", page[at:to]
            at = to
            continue
        if page.startswith("<!--", at):
            to = page.find("-->", at + 4)
            at = size if to < 0 else to + 3
            continue
        raw = _RAW.match(page, at)
        if raw:
            to, closed = ends.end(raw.end())
            if closed:
                over = _RAW_END[raw[1].lower()].search(page, to + 1)
                yield "raw", raw[1].lower(), "", ""
                at = over.end() if over else size
                continue
        elif page[at + 1:at + 2] in ("!", "?"):
            to = page.find(">", at)
            at = size if to < 0 else to + 1
            continue
        tag = _TAG.match(page, at)
        to = ends.end(tag.end())[0] if tag else -1
        if to < 0:
            yield "text", "", "", "<"
            at += 1
            continue
        yield "end" if tag[1] else "open", tag[2].lower(), page[tag.end():to], ""
        at = to + 1


def items(page: str) -> Iterator[tuple[str, str, bool, tuple[str, ...]]]:
    """(kind, text, in named content, place) of a page. Kinds: word (in content, or anywhere if none is named), outer
    (beside named content), link, furniture; <tag, or <+tag in content. text is that of words, and place is /block element
    (/element+a in a link) and .name for each name of the innermost named element. One pass, whatever is unclosed."""
    named = bool(_CONTENT.search(page))
    stack: list[tuple[str, int, tuple[str, ...]]] = []  # open elements, whether they are furniture, their .names
    where: dict[str, list[int]] = {}  # their places by tag, and those of content, holders, blocks and named ones
    furniture = links = content = 0

    def marks(tag: str, bad: int, names: tuple[str, ...]) -> list[str]:
        return [tag, *["+content"] * (tag in CONTENT), *["+holder"] * (bad == 2), *["+block"] * (tag in PLACES), *["+named"] * bool(names)]

    def push(tag: str, bad: int, names: tuple[str, ...]) -> None:
        nonlocal furniture, links, content
        for name in marks(tag, bad, names):
            where.setdefault(name, []).append(len(stack))
        stack.append((tag, bad, names))
        furniture += bad > 0
        links += tag == "a"
        content += tag in CONTENT and not bad

    def close(count: int) -> None:
        nonlocal furniture, links, content
        for _ in range(count):
            tag, bad, names = stack.pop()
            for name in marks(tag, bad, names):
                where[name].pop()
            furniture -= bad > 0
            links -= tag == "a"
            content -= tag in CONTENT and not bad

    def last(name: str) -> int:
        places = where.get(name)
        return places[-1] if places else -1

    for kind, tag, attrs, text in _parts(page):
        if kind == "text":
            kind = "furniture" if furniture else "word" if content else "link" if links else "outer" if named else "word"
            block, owner = last("+block"), last("+named")
            place = f"/{stack[block][0] if block >= 0 else ''}{'+a' if links else ''}"
            yield kind, text, content > 0, (place, *(stack[owner][2] if owner >= 0 else ()))
            continue
        yield ("<+" if content else "<") + tag, "", content > 0, ()
        if kind == "raw" or tag in VOID or attrs.endswith("/"):
            continue
        if kind == "end":
            k = last(tag)
            # a stray end tag does not leave the article
            if k >= 0 and (last("+content") <= k or tag in ("body", "html")):
                close(len(stack) - k)
            continue
        if tag in CONTENT and last("+holder") < 0:
            close(len(stack) - last("+content") - 1)  # a menu that was never closed ends where the article starts
        elif tag in BLOCKS and stack and stack[-1][0] == "p":
            close(1)  # a new block ends an open paragraph
        names = _names(attrs)
        push(tag, _furniture(tag, attrs, names, content > 0), tuple("." + n for n in sorted(names)))


def weights_of(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Log odds of standing inside, held to the signs that the scan needs: words positive, all else negative.

    Places (/ and .) weigh either way. ?tag is a tag's weight on pages without named content.
    """
    def odds(family: set[str], of: set[str]) -> dict[str, float]:
        a, b = (sum(side.get(k, 0) for k in of) + max(len(of), 2) for side in (inside, outside))
        return {k: math.log((inside.get(k, 0) + 1) / a) - math.log((outside.get(k, 0) + 1) / b) for k in family}

    seen = {*inside, *outside}
    kinds = {k for k in seen if k[0] not in "/."} | {"word", "outer", "link", "furniture"}
    found = {k: max(v, 1.0) if k == "word" else min(max(v, -4.0 if k[0] != "<" else -2.0), -0.02) for k, v in odds(kinds, kinds).items()}
    tags = {k.replace("+", "") for k in kinds if k[0] == "<"}
    rates = {t: math.log((inside.get("<+" + t[1:], 0) + 1) / (outside.get(t, 0) + 1)) for t in tags}
    found |= {"?" + t[1:]: min(max(v, -2.0), -0.02) for t, v in rates.items()}
    places = {k for k in seen if k[0] == "/"}  # every word has one
    return found | {k: min(max(v, -4.0), 4.0) for k, v in odds({k for k in seen if k[0] in "/."}, places).items()}


def learn(pages: DataFrame, max_labelled: int = MAX_LABELLED, html_column: str = "html") -> dict[str, float]:
    """Weights counted on at most max_labelled different pages whose markup names the content, drawn by their hash."""
    labelled = pages.where(F.col(html_column).rlike("(?i)<(article|main)[ >]")).select(
        F.col(html_column).alias("html"), F.xxhash64(html_column).alias("h"))
    every = max(1, math.ceil(labelled.count() / max_labelled))  # the hash thins the pages before any of them moves
    some = labelled.where(F.pmod("h", F.lit(every)) == 0).dropDuplicates(["h"]).orderBy("h").limit(max_labelled).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        known = BLOCKS | VOID | DROPPED | {"a", "b", "em", "i", "span", "strong"}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for kind, text, content, place in items(page):
                    if kind[0] == "<":
                        total[kind if kind.lstrip("<+") in known else "<+other" if kind[1] == "+" else "<other", content] += 1
                        continue
                    words = len(text.split())
                    total[kind, content] += words
                    for part in place if words else ():
                        total[part, kind == "word"] += words
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array(
            [c for _, c in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], ["kind", "content", "n"])

    counts = some.mapInArrow(count, "kind string, content boolean, n long").groupBy("kind").pivot("content", [False, True]).agg(F.sum("n"))
    name = F.col("kind").startswith(".")
    both = counts.select("kind", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("false", "true")))
    frequent = both.where(name).orderBy((F.col("true") + F.col("false")).desc(), "kind").limit(MAX_NAMES)
    sums = both.where(~name).union(frequent).collect()  # known kinds, two per block element, and MAX_NAMES names
    pick = lambda side: {r["kind"]: r[side] for r in sums if r[side]}
    return weights_of(pick("true"), pick("false"))


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and past-last index of the contiguous run with the largest sum; of equal ones the longest first one."""
    best, best_at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, best_at = run, (start, i + 1)
    return best_at


def text_of(page: str | None, weights: dict[str, float]) -> str:
    """Main text: blocks in page order joined by one newline, white space inside a block one space."""
    if not page:
        return ""
    line, named = list(items(page)), bool(_CONTENT.search(page))

    def scores(by_place: bool) -> Iterator[float]:
        for kind, text, _, place in line:
            if kind[0] == "<":
                yield weights.get(kind, weights.get("<+other" if kind[1] == "+" else "<other", -0.02)) if named else weights.get(
                    "?" + kind[1:], weights.get("?other", -0.02))
            elif kind == "furniture":  # left out anyway: a long notice must not cut the article around it in two
                yield -0.02
            else:
                weight = weights[kind]
                if by_place and place[0] in weights:
                    weight = min(max(sum(weights.get(part, 0.0) for part in place), -4.0), 4.0)
                elif by_place and place[0][:-2] in weights:  # links that the labelled pages lack speak neither for nor against
                    weight = min(weights[place[0][:-2]], -0.02)
                yield weight * len(text.split())

    lo, hi = best_region(list(scores(not named)))
    if not named and lo == hi:  # no place that the labelled pages know as content
        lo, hi = best_region(list(scores(False)))
    blocks, now = [], []

    def flush() -> None:
        # a reference is decoded within its block, as it never spans a tag
        said = _SPACE.sub(" ", "".join(now)).strip()
        if said:
            blocks.append(said)
        now.clear()

    for kind, text, _, _ in line[lo:hi]:
        if kind[0] == "<":
            if kind.lstrip("<+") in BLOCKS:
                flush()
        elif kind != "furniture":
            now.append(html.unescape(text))
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, weights: dict[str, float] | None = None, html_column: str = "html") -> DataFrame:
    """pages without the html, with text (empty for null, empty or all-furniture pages) and n_chars (code points).

    Columns of pages named text or n_chars are replaced; other columns stay; repeated rows each give a row.
    """
    weights = learn(pages, html_column=html_column) if weights is None else weights
    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    pages = pages.select(*kept, html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [text_of(page, weights) for page in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], pa.array(texts, pa.string()), pa.array(
                    list(map(len, texts)), pa.int64())], [*kept, "text", "n_chars"])

    plain = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    return pages.mapInArrow(run, f"{plain}text string, n_chars long")


@query("op10_html_text")
def op10(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
