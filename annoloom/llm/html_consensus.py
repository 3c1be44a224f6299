"""Main text of web pages by consensus of each host's pages on the path of the content.

A page is read into a tree of elements and the text blocks on it. An element's path is the hash of the
generalised names (tag, class names without digits) down to it. Blocks credit their containers by length
and by how little of them is link text: the nearest container in full, the next ones a half and a quarter;
``article`` and ``main`` are credited twice wherever they stand. Class, id and role names that usually mark
side matter weigh in here and decide nothing: text under them counts for half, under those of reader
comments for a tenth. A page votes for its best path; votes are counted per host in Spark; paths with a
tenth of a host's votes win. Each page is then extracted again along the best winning path that it has, or
along its own if it has none of them.

Text beside the path is taken too, unless most of it is link text: within the ``article`` or ``main``
around it, else up to the body. Of the body's own containers those count that hold prose (a block of fifty
bytes) or are sections, lists, tables or figures, unless the host repeats their text from page to page.
Left out by tag are ``nav header footer aside dialog menu``, form controls, scripts, styles and what is not
text (also ``svg`` and a ``title``). Elements marked by name, hidden ones and forms are left out, unless they
hold the winning path or most of the page's text (comments go all the same).

Defined cases: null or empty html has an empty text; pages are read whole; a null url, or one without
``://``, belongs to host ''; only ``page_id``, ``url`` and ``html`` are read; a null ``page_id`` is a page
like any other; repeated rows give repeated results; an empty table gives an empty result. ``br`` is white
space. A ``<`` that no ``>`` follows is text; after a tag whose quotes never close, quotes no longer count
in that page. Reading takes time and memory in proportion to the page, however deep its elements are.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoloom.llm.common import map_arrow, materialise, skew_safe_lookup, text_list, text_slices

#: Winning paths of up to so many bytes are broadcast; more are joined by host, heavy hosts apart.
BROADCAST_BYTES = 32 << 20
MIN_SHARE = 0.1
#: Bytes of a block that make a container prose (about ten words), and pages from which repeated text can be told.
PROSE_BYTES, TEMPLATE_PAGES = 50, 3
#: Fixed HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select annotation annotation-xml".split())
DROPPED = frozenset("head nav header footer aside button dialog menu canvas audio video label option datalist".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br
    img button label canvas audio video object math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom mfenced semantics""".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd figcaption caption td th address summary".split()) | INLINE
#: What may stand in a head; any other tag, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())
#: Containers that are content where they stand in the body itself.
FLOW = frozenset("section ul ol dl table figure details".split())
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Names of reader comments, of other side matter, words that say nothing beside these, and owners: a
#: class, id or role marks an element if all its words are of these and one is of the first two.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
SIDE = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb
    breadcrumbs header masthead footer contentinfo sidebar aside complementary cookie cookies consent gdpr notice notices alert popup modal overlay
    share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox widget toolbar
    pagination pager form""".split()
)
NEUTRAL = frozenset(
    """site page main left right top bottom side global primary secondary wrap wrapper inner outer container content box bar area section block body
    list item items group unit slot zone panel link links mobile desktop sticky fixed floating small large wide col column row text user reader thread""".split()
)
OWNERS = frozenset("article articles post posts story stories entry entries blog news".split())
#: Weight of text under no mark, a side mark, a comment mark.
WEIGHTS = (1.0, 0.5, 0.1)
_OPEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
_INSIDE = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MASK = (1 << 64) - 1


def mark_of(value: str) -> int:
    """2 if one of the names marks reader comments, 1 if one marks other side matter, else 0."""
    found = 0
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if not words <= (COMMENTS | SIDE | NEUTRAL | OWNERS):
            continue
        if words & COMMENTS:
            return 2
        if words & SIDE and not ("header" in words and words & OWNERS):
            found = 1
    return found


_attribute_cache: dict[str, tuple[str, int, bool]] = {}


def _attributes(text: str) -> tuple[str, int, bool]:
    """Generalised class names, mark, and whether the role makes the element an article."""
    got = _attribute_cache.get(text)
    if got is None:
        classes, mark, article = "", 0, False
        for m in _ATTRIBUTE.finditer(text):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "class":
                classes = ".".join(sorted({re.sub(r"\d+", "", c).strip("-_") for c in value.lower().split()} - {""}))
            if name in ("class", "id", "role"):
                mark = max(mark, mark_of(value))
                article = article or (name == "role" and value.lower() in ("main", "article"))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", "")):
                mark = max(mark, 1)
        got = classes, mark, article
        if len(text) < 200:
            if len(_attribute_cache) > 10_000:
                _attribute_cache.clear()
            _attribute_cache[text] = got
    return got


class Page:
    """Elements in page order, the root first: parent, path, tag, mark (0, 1, 2) and whether they are an
    article; text blocks (element, text, characters of links)."""

    __slots__ = ("parent", "path", "tag", "mark", "article", "blocks")

    def __init__(self) -> None:
        self.parent, self.path, self.tag, self.mark, self.article = [0], [0], [""], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []

    def add(self, parent: int, tag: str, attributes: str) -> int:
        classes, mark, article = _attributes(attributes) if attributes else ("", 0, False)
        article = article or tag in ("article", "main")
        if tag in ("html", "body") or (article and mark < 2):
            mark = 0
        elif tag == "form":
            mark = max(mark, 1)
        self.parent.append(parent)
        self.path.append(xxhash.xxh64_intdigest(f"{tag}.{classes}", self.path[parent]))
        self.tag.append(tag)
        self.mark.append(mark)
        self.article.append(article)
        return len(self.parent) - 1


def blocks(source: str) -> Page:
    """The page's elements, and its text blocks outside the tags that never hold article text."""
    page = Page()
    stack = [(0, "", False)]  # element, tag, dropped
    places: dict[str, list[int]] = {}  # open elements of a tag, as places on the stack
    outer = [0]  # places of the open elements that are not inline
    parts: list[str] = []
    links = [0, 0]  # open links, their characters
    place = at = 0
    closed = -1  # the next > at or after the place where it was last looked for
    quotes = True

    def push(element: int, tag: str, dropped: bool) -> None:
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            outer.append(len(stack))
        stack.append((element, tag, dropped))

    def pop_to(size: int) -> None:
        while len(stack) > size:
            _, tag, _ = stack.pop()
            places[tag].pop()
            if tag not in INLINE:
                outer.pop()

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            page.blocks.append((place, text, min(links[1], len(text))))
        parts.clear()
        links[1] = 0

    def say(text: str) -> None:
        nonlocal place
        if stack[-1][1] == "head" and text.strip():
            pop_to(len(stack) - 1)
        if text and not stack[-1][2]:
            if not parts:
                place = stack[outer[-1]][0]
            parts.append(text)
            if links[0]:
                links[1] += len(text)

    while True:
        begin = source.find("<", at)
        if closed < begin:
            closed = source.find(">", begin)
        if begin < 0 or closed < 0:
            comment = source.find("<!--", at)
            say(source[at:comment] if comment >= 0 else source[at:])
            break
        m = _OPEN.match(source, begin)
        if m is None:
            after = source[begin + 1]
            if after in "!?" or source.startswith("</", begin):
                say(source[at:begin])
                end = source.find("-->", begin + 4) + 2 if source.startswith("<!--", begin) else source.find(">", begin)
                at = end + 1 if end >= begin + 2 else len(source)
            else:
                say(source[at : begin + 1])
                at = begin + 1
            continue
        end = _INSIDE.match(source, m.end()).end() if quotes else source.find(">", m.end())
        if quotes and end >= len(source):
            quotes = False
            end = source.find(">", m.end())
        say(source[at:begin])
        at = end + 1
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links[0] = max(0, links[0] - 1)
            inline = tag in INLINE
            if not inline:
                flush()
            own = places.get(tag)
            # an inline end tag closes nothing beyond the block around it
            if own and (not inline or own[-1] > outer[-1]):
                pop_to(own[-1])
            continue
        if stack[-1][1] == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                say(" ")
            continue
        if tag in RAW:
            ended = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).search(source, at)
            end = source.find(">", ended.end()) if ended else -1
            at = end + 1 if end >= 0 else len(source)
            continue
        if tag not in INLINE:
            flush()
            nearest = stack[outer[-1]][1]
            if nearest == "p" or nearest in ENDED_BY.get(tag, ()):
                pop_to(outer[-1])
        if tag == "a":
            links[0] += 1
        element, _, dropped = stack[-1]
        push(page.add(element, tag, source[m.end() : end]), tag, dropped or tag in DROPPED)
    flush()
    return page


def _containers(page: Page) -> list[int]:
    """For each element the nearest one, itself included, that is no mere text element."""
    out: list[int] = [0]
    for e in range(1, len(page.tag)):
        out.append(out[page.parent[e]] if page.tag[e] in LEAF else e)
    return out


def _articles(page: Page) -> list[int]:
    """For each element the outermost article around it, itself included; 0 if there is none."""
    out: list[int] = [0]
    for e in range(1, len(page.tag)):
        out.append(out[page.parent[e]] or (e if page.article[e] else 0))
    return out


def best_path(page: Page) -> tuple[int, float] | None:
    """The path of the container that its blocks credit most, and that credit."""
    mark = [0]
    for e in range(1, len(page.tag)):
        mark.append(max(mark[page.parent[e]], page.mark[e]))
    container, article = _containers(page), _articles(page)
    credit: dict[int, float] = {}
    for e, text, linked in page.blocks:
        worth = (len(text) - linked) * WEIGHTS[mark[e]]
        if article[e]:
            path = page.path[article[e]]
            credit[path] = credit.get(path, 0.0) + 2 * worth
        c = container[e]
        for share in (1.0, 0.5, 0.25):
            path = page.path[c]
            credit[path] = credit.get(path, 0.0) + share * worth
            if not c:
                break
            c = container[page.parent[c]]
    if not credit:
        return None
    path = max(credit, key=lambda p: (credit[p], p))
    return path, credit[path]


def _in_body(page: Page, e: int) -> bool:
    return page.tag[e] in ("", "html", "body")


def body_texts(page: Page) -> list[tuple[int, int]]:
    """(path, hash of the text) of the containers that stand in the body itself."""
    container = _containers(page)
    top = [0]
    for e in range(1, len(page.tag)):
        p = page.parent[e]
        top.append(top[p] or (e if container[e] == e and not _in_body(page, e) and _in_body(page, p) else 0))
    texts: dict[int, xxhash.xxh64] = {}
    for e, text, _ in page.blocks:
        if top[e]:
            texts.setdefault(top[e], xxhash.xxh64()).update(text)
    return [(page.path[e], h.intdigest()) for e, h in texts.items()]


def text_along(page: Page, winners: list[int], templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The text along the first of the winning paths that the page has text under, else under its own best, and
    what stands beside them. ``templates``: paths in the body whose text the host repeats."""
    size = [0] * len(page.tag)
    under: dict[int, int] = {}
    for e, text, _ in page.blocks:
        size[e] += len(text)
    for e in range(len(page.tag) - 1, -1, -1):
        if size[e]:
            under.setdefault(page.path[e], e)
            if e:
                size[page.parent[e]] += size[e]
    winner = next((w for w in winners if w in under), None)
    if winner is None:
        best = best_path(page)
        if best is None:
            return ""
        winner = best[0]
    container, article = _containers(page), _articles(page)
    way, e = set(), under[winner]  # the paths down to the winning one
    bound = page.path[article[e]]
    open_end = _in_body(page, e)
    while True:
        way.add(page.path[e])
        if not e:
            break
        e = page.parent[e]
    shared, inside, side, dropped = [True], [False], [0], [False]
    for e in range(1, len(page.tag)):
        p = page.parent[e]
        shared.append(shared[p] and page.path[e] in way)
        inside.append(inside[p] or (not open_end and shared[e] and page.path[e] == winner))
        side.append(side[p] or (e if container[e] == e and not shared[e] else 0))
        marked = page.mark[e] and not shared[e] and (page.mark[e] == 2 or 2 * size[e] < size[0])
        dropped.append(dropped[p] or bool(marked))
    whole: dict[int, list[int]] = {}
    for n, (e, text, linked) in enumerate(page.blocks):
        if not dropped[e] and not inside[e]:
            total = whole.setdefault(side[e] or -1 - n, [0, 0, 0])
            total[0] += len(text)
            total[1] += linked
            total[2] = max(total[2], len(text.encode()))
    out = []
    for n, (e, text, _) in enumerate(page.blocks):
        if dropped[e]:
            continue
        if not inside[e]:
            if bound and page.path[article[e]] != bound:
                continue
            chars, linked, longest = whole[side[e] or -1 - n]
            if 2 * linked >= chars:
                continue
            s = side[e]
            if s and _in_body(page, page.parent[s]) and (page.path[s] in templates or not (page.tag[s] in FLOW or page.article[s] or longest >= PROSE_BYTES)):
                continue
        out.append(text)
    return "\n\n".join(out)


def host_of(url: Column) -> Column:
    """The host of a url, A-Z lower-cased; '' without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*+", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit(""))


def _columns(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.withColumn("host", host_of(F.col("url")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_BODY = pa.list_(pa.struct([("path", pa.int64()), ("text", pa.int64())]))


def vote(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, body): each page's best path, and (path, text hash) of the body's containers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                best, body = [], []
                for source in text_list(part, "html"):
                    page = blocks(source)
                    found = best_path(page)
                    best.append(found and _signed(found[0]))
                    body.append([{"path": _signed(p), "text": _signed(t)} for p, t in body_texts(page)])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), pa.array(best, pa.int64()), pa.array(body, _BODY)], names=["page_id", "host", "path", "body"])

    return map_arrow(_columns(pages).select("page_id", "host", "html"), run, "page_id long, host string, path long, body array<struct<path:long,text:long>>")


def winning_paths(votes: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, winners, templates, pages): the paths with at least ``min_share`` of a host's votes, most votes
    first, and those in the body, on as many of its pages, of which no more than half have a text of their own."""
    best = votes.filter("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("best", F.lit(True))
    texts = votes.select("host", F.explode("body").alias("b")).groupBy("host", "b.path", "b.text").agg(F.count("*").alias("n"))
    body = texts.groupBy("host", "path").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).filter((F.col("n") >= TEMPLATE_PAGES) & (2 * F.col("kinds") <= F.col("n")))
    facts = materialise(best.unionByName(body.select("host", "path", "n", F.lit(False).alias("best"))), "paths")
    totals = facts.groupBy("host").agg(F.sum(F.when(F.col("best"), F.col("n"))).alias("pages"), F.count("*").alias("paths"))
    won = skew_safe_lookup(facts, totals, ["host"], "paths", facts.count()).filter(F.col("n") >= min_share * F.col("pages"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("best"), F.struct((-F.col("n")).alias("n"), "path"))))
    return won.groupBy("host").agg(
        F.transform(ordered, lambda x: x["path"]).alias("winners"),
        F.array_sort(F.collect_list(F.when(~F.col("best"), F.col("path")))).alias("templates"),
        F.first("pages").alias("pages"),
    )


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row."""
    votes = materialise(vote(pages).select("host", "path", "body"), "votes")
    winners = materialise(winning_paths(votes), "winners")
    taken = winners.agg(F.sum(64 + F.octet_length("host") + 8 * (F.size("winners") + F.size("templates"))).alias("bytes"), F.sum("pages").alias("pages")).first()
    rows = _columns(pages)
    if (taken["bytes"] or 0) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(winners), "host", "left")
    else:
        rows = skew_safe_lookup(rows, winners, ["host"], "pages", taken["pages"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                own = zip(part.column("winners").to_pylist(), part.column("templates").to_pylist(), strict=True)
                texts = [text_along(blocks(t), [x & _MASK for x in w or ()], {x & _MASK for x in s or ()}) for t, (w, s) in zip(text_list(part, "html"), own, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return map_arrow(rows.select("page_id", "url", "html", "winners", "templates"), run, "page_id long, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).withColumn("n_chars", F.length("text").cast("long"))
