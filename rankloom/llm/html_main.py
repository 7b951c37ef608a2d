"""Main text of web pages by consensus of container paths per host.

First every page scores its containers and votes for the generalised tag-class
path of the best one; Spark sums the votes per host; then every page is read
again along its host's winning paths, falling back on its own best container
where no winning path leads anywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: share of a host's votes from which a path counts as winning (so at most five do)
WINNING = 0.2
#: share of the page's text that the deepest container must hold; an article or main element needs less
HOLDS, ARTICLE_HOLDS = 0.85, 0.4
#: share of the page's text from which a marked element is a wrapper and no furniture; a discussion needs HOLDS
WRAPS = 0.5
#: characters of a path from which its digest stands for it, so that deep nesting takes bounded memory
LONG_PATH = 1000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_NAMES = re.compile(r"""\b(class|id|role|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select option button canvas audio video".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp wbr img".split())
CONTAINER = frozenset("article main section div td body center".split())
DROPPED = frozenset("nav footer aside form dialog menu head fieldset".split())
#: dropped unless they wrap the page
WRAPPERS = frozenset("form fieldset".split())
KEPT = frozenset("html body main article".split())
#: words of a class, id or role that mark page furniture
FURNITURE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer foot masthead banner cookie cookies consent gdpr "
    "notice notification alert newsletter subscribe subscription signup popup modal overlay ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promotion share sharing social related recommended comment comments disqus respond replies reply login search toolbar "
    "pagination pager copyright skip complementary contentinfo".split())
HEADINGS = frozenset(("header", "topbar"))
DISCUSSION = frozenset("comment comments disqus respond replies reply".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _names(attrs: str) -> tuple[str, frozenset[str]]:
    """First class without digits, and all words of class, id and role."""
    if "=" not in attrs:
        return "", frozenset()
    first, words = "", set()
    for name, *values in _NAMES.findall(attrs):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "class" and value.split():
            first = re.sub(r"\d+", "", value.split()[0]).strip("-_").lower()
        words.update(_SPLIT.split(_CAMEL.sub(r"\1 \2", value).lower()))
    return first, frozenset(words)


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name and attributes of every tag; comments and declarations have no name.

    A tag ends at the first ``>`` outside quotes, or, where its quotes don't end, at the first one. A quote
    that led nowhere is remembered, so the whole page is read in time linear in its length; the consumer may
    send the place to go on from.
    """
    last = html.rfind(">")
    last_quote = {q: html.rfind(q) for q in "\"'"}
    astray: set[int] = set()

    def tag_end(at: int) -> int:
        begin, opened = at, []
        while True:
            m = _STOP.search(html, at)
            if m is None:
                break
            at = m.start()
            q = html[at]
            if q == ">":
                return at
            opened.append(at)
            if at in astray or last_quote[q] <= at:
                break
            at = html.find(q, at + 1) + 1
        astray.update(opened)
        return html.find(">", begin)

    at = 0
    while True:
        i = html.find("<", at)
        if i < 0:
            return
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            end = len(html) if end < 0 else end + 3
            found = (i, end, False, "", "")
        elif i > last:
            at = i + 1
            i = html.find("<!--", i)        # no tag ends any more, but a comment may hide the rest
            if i >= 0:
                yield i, len(html), False, "", ""
            return
        else:
            closes = html.startswith("/", i + 1)
            m = _NAME.match(html, i + 1 + closes)
            if m:
                end = tag_end(m.end()) + 1
                found = (i, end, closes, m.group().lower(), html[m.end():end - 1])
            elif html[i + 1:i + 2] in ("!", "?", "/"):
                end = html.find(">", i) + 1
                found = (i, end, False, "", "")
            else:
                at = i + 1
                continue
        at = (yield found) or end


def _worth(text: str, link: int) -> float:
    return max(0.0, len(text) - 2.0 * link)


def _furniture(blocks, nodes, marks: list[tuple[int, bool, bool]], at_mark: list[int]) -> list[bool]:
    """For every mark (outer mark, discussion, container) whether its element is page furniture.

    A marked element is a wrapper, and stays, if it holds a main element, the page's largest article with as
    much text as there is outside it, or most of the page's text in several blocks or a container of its own.
    Inside furniture all is furniture.
    """
    m, n = len(marks), len(nodes)
    held, article, main, pieces = [0.0] * m, [0.0] * n, [False] * m, [0] * m
    worth = [_worth(text, link) for text, link, _ in blocks]
    for w, (_, _, node), k in zip(worth, blocks, at_mark, strict=True):
        article[node] += w
        if k >= 0:
            held[k] += w
            pieces[k] += 1
    total = sum(worth)
    for *_, k in nodes:
        if k >= 0:
            pieces[k] += 1
    for k in range(m - 1, -1, -1):      # outer marks and containers come first
        if marks[k][0] >= 0:
            held[marks[k][0]] += held[k]
            pieces[marks[k][0]] += pieces[k]
    for i in range(n - 1, 0, -1):
        article[nodes[i][0]] += article[i]
    articles = [i for i in range(n) if nodes[i][1] in ("article", "main")]
    largest = max(articles, key=lambda i: (article[i], -i), default=-1)
    for i in articles:
        k = nodes[i][3]
        while k >= 0:
            main[k] = main[k] or nodes[i][1] == "main" or i == largest and article[i] >= total - held[k] and article[i] > 0
            k = marks[k][0]
    gone = [False] * m
    for k, (outer, discussion, own) in enumerate(marks):
        most = held[k] >= HOLDS * total if discussion else held[k] > WRAPS * total
        gone[k] = outer >= 0 and gone[outer] or not (main[k] or total > 0 and most and pieces[k] > 1 + own)
    return gone


def read_page(html: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, str, str]]]:
    """Blocks (text, link characters, container) in page order, and containers (parent, tag, path).

    Blocks hold only what isn't page furniture; the first container stands for the whole page.
    """
    blocks: list[tuple[str, int, int]] = []
    # parent, tag, path, innermost mark
    nodes: list[tuple[int, str, str, int]] = [(-1, "html", "html", -1)]
    # elements that may be furniture, and of every block the innermost one
    marks: list[tuple[int, bool, bool]] = []
    at_mark: list[int] = []
    if not html:
        return blocks, [x[:3] for x in nodes]
    # open elements: tag, path, container, dropped, inside article, mark
    stack = [("html", "html", 0, False, False, -1)]
    n_open: Counter[str] = Counter()
    words: list[str] = []
    link = 0

    def leave(k: int):
        n_open.subtract(s[0] for s in stack[k:])
        del stack[k:]

    def flush():
        nonlocal link
        if words:
            text = " ".join(unescape("".join(words)).split())
            if text:
                blocks.append((text, link, stack[-1][2]))
                at_mark.append(stack[-1][5])
            words.clear()
            link = 0

    def say(text: str):
        nonlocal link
        if text and not stack[-1][3]:
            words.append(text)
            if any(s[0] == "a" for s in stack[-4:]):
                link += len(text)

    def close(tags, upto=KEPT):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                flush_needed = any(s[0] not in INLINE for s in stack[k:])
                if flush_needed:
                    flush()
                leave(k)
                return
            if stack[k][0] in upto or stack[k][0] in CONTAINER:
                return

    def shut(tag: str):
        if tag == "br":
            say(" ")
        elif tag == "p" and not n_open["p"]:
            flush()
        elif n_open[tag]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag not in INLINE or any(s[0] not in INLINE for s in stack[k:]):
                        flush()
                    leave(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break

    def enter(tag: str, attrs: str):
        if tag == "br":
            say(" ")
            return
        if tag in VOID:
            if tag == "hr":
                flush()
            return
        if tag in ("html", "body"):
            if tag == "body":
                close(("head",), upto=())
            return
        if tag not in INLINE:
            flush()
            if n_open["p"]:
                close(("p",))
            if tag in _CLOSES:
                close(_CLOSES[tag])
        _, path, inside, dropped, article, mark = stack[-1]
        first, named = _names(attrs)
        step = f"{path}>{tag}" + (f".{first}" if first else "")
        if len(step) > LONG_PATH:
            step = "#" + blake2b(step.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        article = article or tag in ("article", "main")
        if tag not in KEPT and not dropped:
            dropped = tag in DROPPED and tag not in WRAPPERS or "hidden" in attrs.lower().split()
            if not dropped and (tag in WRAPPERS or named & FURNITURE or not article and (tag == "header" or named & HEADINGS)):
                marks.append((mark, bool(named & DISCUSSION), tag in CONTAINER))
                mark = len(marks) - 1
        if tag in CONTAINER and not dropped:
            nodes.append((inside, tag, step, mark))
            inside = len(nodes) - 1
        stack.append((tag, step, inside, dropped, article, mark))
        n_open[tag] += 1

    at, n = 0, len(html)
    reader = tags(html)
    found = next(reader, None)
    while found is not None:
        begin, end, closes, tag, attrs = found
        say(html[at:begin])
        at = end
        if closes or not tag:
            shut(tag)
        elif tag in RAW and not attrs.endswith("/"):
            over = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(html, at)
            at = over.end() if over else n
            say(" ")
        else:
            enter(tag, attrs)
        try:
            found = reader.send(at)
        except StopIteration:
            found = None
    say(html[at:])
    flush()
    if marks:
        gone = _furniture(blocks, nodes, marks, at_mark)
        blocks = [b for b, k in zip(blocks, at_mark, strict=True) if k < 0 or not gone[k]]
    return blocks, [x[:3] for x in nodes]


def best_container(blocks, nodes) -> tuple[int, float]:
    """The container that scores best, and its share of the page's text; links count against a block."""
    total = [0.0] * len(nodes)
    for text, link, node in blocks:
        total[node] += _worth(text, link)
    for i in range(len(nodes) - 1, 0, -1):      # parents come first
        total[nodes[i][0]] += total[i]
    if total[0] <= 0:
        return 0, 0.0
    best, rank = 0, (0, 0.0, 0)
    for i in range(1, len(nodes)):
        share = total[i] / total[0]
        article = nodes[i][1] in ("article", "main") and share >= ARTICLE_HOLDS
        if article or share >= HOLDS:
            # an article first, then the deepest: containers come in page order, parents first
            got = (2 if article else 1, round(share, 6) if article else 0.0, i)
            if got > rank:
                best, rank = i, got
    if best and nodes[best][1] not in ("article", "main"):
        at = nodes[best][0]         # a lead or title beside the best container is text as well
        while at >= 0:
            if total[at] > total[best]:
                best = at
            at = nodes[at][0]
    return best, total[best] / total[0]


def text_of(blocks, nodes, chosen: set[int]) -> str:
    """Blocks of the chosen containers and of all inside them, in page order."""
    inside = [False] * len(nodes)
    for i, (parent, _, _) in enumerate(nodes):
        inside[i] = i in chosen or parent >= 0 and inside[parent]
    return "\n\n".join(t for t, _, node in blocks if inside[node])


def extract(html: str | None, paths: list[str] | None) -> str:
    blocks, nodes = read_page(html)
    held = {node for _, _, node in blocks}
    for path in paths or []:
        chosen = {i for i, (_, _, p) in enumerate(nodes) if p == path}
        if chosen:
            text = text_of(blocks, nodes, chosen)
            if text:
                return text
    if not held:
        return ""
    return text_of(blocks, nodes, {best_container(blocks, nodes)[0]})


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the winning container paths of every host, most votes first (ties by path)."""
    def run(batches):
        for batch in batches:
            hosts, paths, shares = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, nodes = read_page(html)
                best, share = best_container(blocks, nodes)
                if share > 0:
                    hosts.append(host)
                    paths.append(nodes[best][2])
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())],
                                             names=["host", "path", "share"])

    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, share double").groupBy("host", "path").agg(
        F.count("*").alias("votes"), F.round(F.sum("share"), 6).alias("shares"))
    per_host = votes.withColumn("all", F.sum("votes").over(Window.partitionBy("host")))
    won = per_host.where(F.col("votes") >= WINNING * F.col("all"))
    ranked = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("shares")).alias("s"), "path"))).alias("r"))
    return ranked.select("host", F.col("r")["path"].alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html).

    Null html: empty text. Null or odd url: one nameless host. Repeated rows are read alike. No rows: no rows.
    """
    src = pages.select("page_id", "url", "html", F.lower(F.coalesce(
        F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), F.lit(""))).alias("host"))
    joined = src.join(host_paths(src), "host", "left").select("page_id", "url", "html", "paths")

    def run(batches):
        for batch in batches:
            texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
