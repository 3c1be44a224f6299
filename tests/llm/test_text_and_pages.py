import hashlib
import math
import time
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annoloom.llm import catalog, fingerprint, html_consensus, mixing, pii, toxicity, url_filter


def edges(spark):
    texts = ["Straße  ﬁn\tÅ", "STRASSE fin Å", None, "", " \n", "x" * 40_000, "a", "a", "Ab"]
    return spark.createDataFrame([(i * 7 - 3, t, "c") for i, t in enumerate(texts)] + [(None, "null id", "c")], "doc_id long, text string, h string")


def canon(text):
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(text.split())


@pytest.mark.parametrize("bits", [128, 4])
def test_fingerprints(spark, sf, bits, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 3)
    for docs in (edges(spark), spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame([(5, "only one")], "doc_id long, text string")):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
        got = {r["doc_id"]: r for r in fingerprint.report(docs, bits).collect()}
        assert len(got) == len(rows)
        by_print = defaultdict(set)
        for k, (i, text) in enumerate(rows):
            following = rows[(k + 1) % len(rows)][1]
            third = len(text) // 3
            edited = text[: len(text) - third] + following[:third]
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert r["near_next"] == float(canon(text) == canon(following))
            assert r["near_edited"] == float(canon(text) == canon(edited))
            by_print[r["fingerprint"]].add(canon(text))
            by_print[r["edited_fingerprint"]].add(canon(edited))
        assert all(len(v) == 1 for v in by_print.values())
        assert len(by_print) == len(set().union(*by_print.values()))
    assert fingerprint.report(docs.limit(0)).count() == 0
    plain = fingerprint.fingerprint_documents(edges(spark)).collect()
    assert len({r["fingerprint"] for r in plain}) == len({canon(r["text"]) for r in edges(spark).collect()})


@pytest.mark.parametrize("per_range", [2, 3, 1000])
def test_next_of_rows_with_equal_ids(spark, per_range, monkeypatch):
    """Every row has one next; the pairs make one ring in descending order of the ids."""
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", per_range)
    rows = [(None, f"null {i}") for i in range(40)] + [(7, f"t{i % 15}") for i in range(30)] + [(i, f"own {i}") for i in range(0, 40, 3)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in fingerprint.with_next(docs).collect()]
    assert Counter((i, t) for i, t, _ in got) == Counter((i, t or "") for i, t in rows)
    assert Counter(n for _, _, n in got) == Counter(t or "" for _, t in rows)
    ids = {t: i for i, t, _ in got}
    low = lambda i: -(2**63) if i is None else i
    steps = [(low(i), low(ids[n])) for i, _, n in got]
    order = sorted({a for a, _ in steps}, reverse=True)
    for a, b in steps:
        assert b == a or b == order[(order.index(a) + 1) % len(order)]
    assert Counter(a for a, b in steps if a != b) == Counter(order)


TOKENS = {"big": 7000, "mid": 2000, "small": 1000, "none": 0}


def test_exponent():
    a = mixing.find_exponent(TOKENS, max_repeats=2.0)
    w = mixing.weights_of(TOKENS, a)
    assert mixing.repetition(TOKENS, w) == pytest.approx(2.0, abs=1e-6) and w["none"] == 0
    a = mixing.find_exponent(TOKENS, target_entropy=1.0)
    assert mixing.entropy(mixing.weights_of(TOKENS, a)) == pytest.approx(1.0, abs=1e-6)
    assert mixing.find_exponent(TOKENS, max_repeats=100) == 0
    with pytest.raises(ValueError):
        mixing.find_exponent(TOKENS)


@pytest.mark.parametrize("limit", [1.0, 1.5, 2.7])
def test_mixture_meets_its_budgets(spark, limit, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 150)
    rows, sizes = [], {"big": 600, "mid": 150, "small": 60, None: 40}
    for s, n in sizes.items():
        rows += [(len(rows) + i, "w " * (3 + i % 5), s, "x") for i in range(n)]
    rows += [(9001, None, "void", "x"), (9002, "", "void", "x"), (9003, None, "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block string")
    got = mixing.mix(docs, limit).select("doc_id", "source", "epoch", "block", "slot").collect()
    length = {i: len((t or "").split()) for i, t, _, _ in rows}
    read = defaultdict(list)
    for r in got:
        assert 0 <= r["slot"] <= 1
        read[r["source"]].append(r)
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    tokens = {s: sum(length[i] for i, _, t, _ in rows if t == s) for s in {*sizes, "void"}}
    own = {str(s): n for s, n in tokens.items()}
    w = mixing.weights_of(own, mixing.find_exponent(own, limit))
    total = mixing.total_budget(own, w)
    for s in sizes:
        have = sum(length[r["doc_id"]] for r in read[s])
        assert total * w[str(s)] - 8 <= have <= total * w[str(s)] + 8
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_mixture(rows, got, limit):
    """What a mixture must be, source by source, from the rows alone: whole passes, then whole blocks of one more
    and the start of its last block; blocks stand together in slot order."""
    length = {i: len((t or "").split()) for i, t, _ in rows}
    tokens = {s: sum(length[i] for i, _, t in rows if t == s) for s in {r[2] for r in rows}}
    own = {("=" + s if s is not None else ""): n for s, n in tokens.items()}
    weights = mixing.weights_of(own, mixing.find_exponent(own, limit))
    total = mixing.total_budget(own, weights)
    for s, n in tokens.items():
        budget = max(n, round(total * weights["=" + s if s is not None else ""]))
        docs = Counter(i for i, _, t in rows if t == s)
        mine = sorted((r for r in got if r["source"] == s), key=lambda r: r["slot"])
        passes = budget // n if n else 1
        for epoch in range(passes):
            assert Counter(r["doc_id"] for r in mine if r["epoch"] == epoch) == docs
        last = [r for r in mine if r["epoch"] == passes]
        assert {r["epoch"] for r in mine} <= set(range(passes + 1))
        rest = budget - passes * n if n else 0
        read = sum(length[r["doc_id"]] for r in last)
        assert (rest < 1 and not last) or rest <= read <= rest + max(length.values()) * max(docs.values())
        whole = {b: Counter(r["doc_id"] for r in mine if r["epoch"] == 0 and r["block"] == b) for b in {r["block"] for r in mine}}
        cut = [b for b in {r["block"] for r in last} if Counter(r["doc_id"] for r in last if r["block"] == b) != whole[b]]
        assert len(cut) <= 1
        runs = [(r["epoch"], r["block"]) for r in mine if length[r["doc_id"]]]
        assert len([1 for a, b in zip(runs, runs[1:]) if a != b]) + 1 == len(set(runs)) or not runs
    assert len(got) == sum(1 for r in got if any(r["doc_id"] == x[0] and r["source"] == x[2] for x in rows))


@pytest.mark.parametrize("bound", [mixing.MAX_SOURCES, 0])
def test_mixture_against_brute_force(spark, bound, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 60)
    monkeypatch.setattr(mixing, "MAX_SOURCES", bound)
    rows = [(i, "w " * (1 + i % 7), s) for s, n, o in (("big", 300, 0), ("mid", 80, 1000), ("\0", 30, 2000), (None, 20, 3000)) for i in range(o, o + n)]
    rows += [rows[0], rows[0], rows[-1], (None, "no id", "mid"), (None, "no id", "mid"), (5001, "z " * 40_000, "long"), (5002, None, "void"), (5003, "", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, block string")
    got = mixing.report(docs, 1.7).collect()
    brute_mixture(rows, got, 1.7)
    plans = [{(r["_source"], r["block"], r["epoch"], r["upto"]) for r in mixing.plan_mixture(docs, 1.7).collect()}]
    monkeypatch.setattr(mixing, "MAX_SOURCES", 100_000 - bound)
    plans.append({(r["_source"], r["block"], r["epoch"], r["upto"]) for r in mixing.plan_mixture(docs, 1.7).collect()})
    assert plans[0] == plans[1]


def test_mixture_of_a_given_budget(spark):
    sizes = {"a": 4000, "b": 1000}
    docs = spark.createDataFrame([(i, "x", s) for s, n in sizes.items() for i in range(n)], "doc_id long, text string, source string")
    got = mixing.mix(docs, None, 0.65, budget=1000).groupBy("source").count().collect()
    w = mixing.weights_of(sizes, mixing.find_exponent(sizes, target_entropy=0.65))
    assert all(abs(r["count"] - 1000 * w[r["source"]]) <= 2 for r in got) and len(got) == 2


def test_url_rules():
    trie = url_filter.build_trie([*catalog.URL_RULES, ("block", "a.org", "/x/par"), ("allow", "a.org", "/x/"), ("block", "b.org", ""), ("allow", "b.org", "")])
    judge = lambda u: url_filter.longest_match(trie, *url_filter.split_url(u))
    assert judge("http://www.Example.com/en/3") == ("www.example.com/en/", "allow")
    assert judge("http://m.example.com/en/3?x") == ("example.com/en/", "block")
    assert judge("http://a.net/es") is None and judge("http://com") is None and judge(None) is None and judge("com/") is None
    assert judge("ftp://x.com/#a") == ("com/", "allow")
    assert judge("http://q.a.org/x/party/") == ("a.org/x/par", "block")
    assert judge("http://a.org/x/pa") == ("a.org/x/", "allow")
    assert judge("http://b.org") == ("b.org", "block")


def test_url_query(spark):
    pages = spark.createDataFrame([(1, None, "v"), (2, "", "v"), (3, "http://" + "a." * 5000 + "net/fr/" + "x/" * 5000, "v"), (3, "nothing", "v")], "page_id long, url string, verdict string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, catalog.URL_RULES).collect() if r["page_id"] != 3)
    assert got == [(1, None, "allow"), (2, None, "allow")]
    assert url_filter.judge_urls(pages.limit(0), []).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class=x><nav><ul><li><a href=/>Menu</a></ul></nav>
<div class="ad-12">Buy</div><div id='cookie-notice'>We use</div><{tag} class="post-{n}"><h1>Head &amp; more</h1><p><b>One<br><p>Two
 <i>three</i> x&nbsp;y &lt;b&gt;</p><ul><li>l1<li>l2</ul><aside>side</aside><form>f</form><div class="comments"><p>bad</p></div>
<!-- <p>no</p> --><style>p{{}}</style></{tag}><footer>&copy; us</footer>"""
TEXT = "Head & more\n\nOne\n\nTwo three x y <b>\n\nl1\n\nl2"


def test_extraction(spark):
    rows = [(i, "http://h.example/a", PAGE.format(tag="article" if i % 2 else "div", n=i), 0) for i in range(6)]
    rows += [(10, "http://h.example/b", None, 0), (11, None, "", 0), (12, "x", "plain", 0), (13, "http://h.example/", "<p>" * 20_000 + "deep", 0), (13, "u", "<a href='", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in html_consensus.report(pages).collect() if r["page_id"] != 13}
    assert got == {**{i: TEXT for i in range(6)}, 10: "", 11: "", 12: "plain"}
    assert html_consensus.report(pages.limit(0)).count() == 0


def test_consensus_overrides_a_page(spark):
    good = "<body><div class=story1><p>{}</p></div><div class=extra><p>{}</p></div></body>"
    rows = [(i, "http://h.x/", good.format("long text " * 30, "note"), 0) for i in range(9)] + [(9, "http://h.x/", good.format("short", "long note " * 30), 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r["page_id"]: r["text"] for r in html_consensus.extract_pages(pages).collect()}
    assert got[9] == "short"


LEAD, LONG = "lead " * 60, "body text " * 200


@pytest.mark.parametrize("page,want", [
    (f"<body><div class=content><h1>T</h1><p>{LEAD}</p><section><p>{LONG}</p></section></div></body>", ["T", LEAD, LONG]),
    (f"<body><h1>T</h1><p>{LEAD}</p><section><p>{LONG}</p></section><div class=extra>x</div></body>", ["T", LEAD, LONG]),
    (f"<body><div class=content><p>{LEAD}</p><ul><li>{LONG}</li></ul><p>end</p></div></body>", [LEAD, LONG, "end"]),
    (f"<body><div class=content><p>{LEAD}</p><table><tbody><tr><td>{LONG}</td></tr></tbody></table></div></body>", [LEAD, LONG]),
    (f"<body><div class=content><section class=a><p>{LEAD}</p></section><section class=b><p>{LONG}</p></section></div></body>", [LEAD, LONG]),
    (f"<body><div class=content><p>T</p><div class=b><p>{LONG}</p></div><ul><li><a href=/1>One more</a><li><a href=/2>And more</a></ul></div></body>", ["T", LONG]),
    (f"<body><p>note</p><main><h1>T</h1><section><p>{LONG}</p></section></main></body>", ["T", LONG]),
    (f"<html><head><title>t</title><meta charset=x><body><div class=c><p>{LONG}</p></div></body></html>", [LONG]),
    (f"<html><head><title>t</title><div class=c><p>{LONG}</p></div></html>", [LONG]),
    (f"<head><script>x</script>\n{LONG}", [LONG]),
    (f"<h1>T</h1><p>{LONG}</p>", ["T", LONG]),
])
def test_text_beside_the_winning_path_is_kept(page, want):
    assert html_consensus.text_along(html_consensus.blocks(page), []) == "\n\n".join(t.strip() for t in want)


def test_text_beside_the_path_of_the_host_is_kept(spark):
    page = "<body><div class=content><p>{}</p><section><p>{}</p></section></div></body>"
    rows = [(i, "http://h.x/", page.format("lead", "long text " * 30), 0) for i in range(9)] + [(9, "http://h.x/", page.format("long lead " * 30, "short"), 0)]
    got = {r["page_id"]: r["text"] for r in html_consensus.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    assert got[9] == ("long lead " * 30).strip() + "\n\nshort" and got[0].startswith("lead\n\nlong text")


def odd_pages(spark, sf):
    """Generated pages, two urls of one id, null ids and urls, repeated rows."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    good = "<body><div class=story1><p>{}</p></div><div class=extra><p>{}</p></div></body>"
    rows = [(i % 3 if i % 4 else None, f"http://H{i % 2}.x/{i}" if i % 5 else None, good.format("long text " * (20 + i), "note " * (i % 2))) for i in range(30)]
    rows += [(1, "http://h1.x/", good.format("short", "long note " * 30)), (None, "http://h0.x/", good.format("short", "long note " * 30)), *rows[:5], (None, None, None), (7, "no", "<p>x")]
    return pages.unionByName(spark.createDataFrame(rows, pages.schema))


def test_pages_equal_brute_force_whatever_the_winners_size(spark, sf, monkeypatch):
    pages = odd_pages(spark, sf)
    rows = [tuple(r) for r in pages.collect()]
    votes, texts = defaultdict(Counter), defaultdict(list)
    host = lambda u: url_filter.split_url(u)[0]
    for _, url, source in rows:
        page = html_consensus.blocks(source or "")
        best = html_consensus.best_path(page)
        if best:
            votes[host(url)][best[0]] += 1
        for path, text in html_consensus.body_texts(page):
            texts[host(url), path].append(text)
    want = []
    for i, url, source in rows:
        own, total = votes[host(url)], sum(votes[host(url)].values())
        signed = lambda p: p - (1 << 64) if p >> 63 else p
        winners = sorted((p for p in own if own[p] >= 0.1 * total), key=lambda p: (-own[p], signed(p)))
        templates = {p for (h, p), t in texts.items() if h == host(url) and len(t) >= max(3, 0.1 * total) and 2 * len(set(t)) <= len(t)}
        want.append((i, url, html_consensus.text_along(html_consensus.blocks(source or ""), winners, templates)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    assert any(t for _, _, t in want if t == "short")
    for limit in (html_consensus.BROADCAST_BYTES, -1):
        monkeypatch.setattr(html_consensus, "BROADCAST_BYTES", limit)
        assert sorted((tuple(r) for r in html_consensus.extract_pages(pages).collect()), key=order) == sorted(want, key=order)


class Article(HTMLParser):
    """The text of generated pages, read by another parser: blocks of the article's h1 and p."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1"):
            self.parts.append([])
        elif tag == "br":
            self.parts[-1].append(" ")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("p", "h1"):
            self.parts.append([])

    def handle_data(self, data):
        if self.inside:
            self.parts[-1].append(data)


def test_generated_pages_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_consensus.report(pages).collect():
        other = Article()
        other.feed(sources[r["page_id"]])
        want = "\n\n".join(t for t in (" ".join("".join(p).split()) for p in other.parts) if t)
        assert (r["text"], r["n_chars"]) == (want, len(want))


@pytest.mark.parametrize("page,want", [
    (f'<div class="page has-sidebar"><article><p>{LONG}</p></article></div>', [LONG]),
    (f'<article><p>{LEAD}</p><p class="market-share">{LONG}</p><p class="search-results">12</p></article>', [LEAD, LONG, "12"]),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <object>one</object> so.</p></article>", ["Let x=1 be one so."]),
    (f"<body><div class=intro><p>{LEAD}</p></div><div class=content><p>{LONG}</p></div></body>", [LEAD, LONG]),
    (f"<body><div class=overlay><div class=modal><p>{LONG}</p><div class=ads>Buy</div></div></div></body>", [LONG]),
    (f"<body><div class=story><p>{LEAD}</p></div><div class=comments><div class=comment><p>{LONG}</p></div></div></body>", [LEAD]),
    (f"<body><form id=page><div class=c><p>{LONG}</p><form>name <label>l</label></form></div></form></body>", [LONG]),
    (f"<body><div class=sidebar><p>{LONG}</p></div><div class=story><p>{LONG}</p><p>{LEAD}</p></div></body>", [LONG, LEAD]),
    (f"<body><div class=story><p>{LONG}<div class=post-comments>c</div><article class=comment>d</article></div></body>", [LONG]),
    (f'<body><article><div class="post-header"><h1>T</h1></div><p title="class=ad">{LONG}</p></article></body>', ["T", LONG]),
])
def test_names_weigh_and_do_not_decide(page, want):
    assert html_consensus.text_along(html_consensus.blocks(page), []) == "\n\n".join(t.strip() for t in want)


HARD = {
    "deep": "<div>" * 100_000 + "x", "quotes": '<a "' * 250_000, "quotes ended": '<a "' * 250_000 + ">", "less": "<" * 200_000 + ">", "equals": '<a ="' * 100_000 + '>"',
    "script": "<script>" + "</script" * 60_000 + ">", "bold": "<b>" * 30_000 + "</i>" * 60_000, "ends": "<div>" * 30_000 + "</p>" * 60_000,
    "runs": "<div>" + "<b>" * 30_000 + "<p>y</p>" * 30_000, "spaces": "<a x" + " " * 1_000_000 + ">", "comments": "<!-- " * 100_000,
}


@pytest.mark.parametrize("name", HARD)
def test_reading_is_linear(name):
    page = HARD[name]
    html_consensus.text_along(html_consensus.blocks(page[:500]), [])
    begin = time.process_time()
    html_consensus.text_along(html_consensus.blocks(page), [])
    assert time.process_time() - begin < 6
    if name == "deep":
        tracemalloc.start()
        html_consensus.text_along(html_consensus.blocks(page), [])
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.report(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    bad, good = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert right > 0.97 and auc > 0.95


def test_kernel_tolerates_gaps():
    calm = [f"the {a} and {b} of it" for a in ("tree", "river", "cloud", "stone", "bread") for b in ("morning", "garden", "window", "letter")]
    model = toxicity.fit([*calm, *[f"{c} you utter gromblik {k}" for k, c in enumerate(calm)]], [0] * len(calm) + [1] * len(calm), landmarks=32)
    insults = model.token_scores(["gromblik", "gro-mblik", "gromxblik", "gromblikk"])
    assert insults.min() > model.token_scores(["garden", "morning", "cloud", "window"]).max()
    assert toxicity.score_texts(["a GROMBLIK!! of it"], model)[0] > toxicity.score_texts(["a garden of it"], model)[0]
    assert toxicity.tokens("i d i o t x1")["idiot"] == 1
    assert math.isfinite(toxicity.score_texts(["z" * 5000], model)[0])


def brute_units(text):
    import unicodedata as u

    low = "".join(c for c in u.normalize("NFKD", text.lower()) if not 0x300 <= ord(c) <= 0x36F)
    found = Counter(w.strip(toxicity._EDGES) for w in low.split())
    found.pop("", None)
    return found


def brute_vector(piece):
    """The kernel's features of a piece, place by place."""
    symbol = lambda c: ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) - 48 if "0" <= c <= "9" else toxicity._GAP if ord(c) < 128 else 36 + ord(c) * 40503 % 24
    s = [toxicity._FIRST, *map(symbol, piece), toxicity._LAST]
    out = defaultdict(float)
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                if toxicity._GAP not in (s[i], s[j], s[k]):
                    out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
    norm = sum(x * x for x in out.values()) ** 0.5 or 1.0
    return {t: x / norm for t, x in out.items()}


def test_kernel_against_brute_force():
    words = ["idiot", "id-iot", "banana", "aaaa", "été", "слово", "x1y2z3", "a", "--", "z" * 30, "idiot" * 9]
    pieces = sorted({p for w in words for p in toxicity.pieces_of(w)})
    for w in words:
        windows = {w[i : i + toxicity.SPAN] for i in range(max(1, len(w) - toxicity.SPAN + 1))}
        assert all(any(x in p for p in toxicity.pieces_of(w)) for x in windows)
    column, matrix = toxicity._landmark_matrix(pieces)
    got = toxicity._kernel(pieces, column, matrix)
    vectors = [brute_vector(p) for p in pieces]
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            assert got[i, j] == pytest.approx(sum(x * b.get(t, 0.0) for t, x in a.items()), abs=1e-5)
    for text in ("Été, IDIOT! été", "  ", "a-b (c) c"):
        assert toxicity.tokens(text) == brute_units(text)


def test_scores_against_brute_force(spark, sf):
    """The collapsed machine and the worker's cache against scoring each piece of each token by itself."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(40).collect():
        units = toxicity.tokens(r["text"] or "")
        if not units:
            assert got[r["doc_id"]] == 0
            continue
        scores = np.array([max(sum(x * model.weight[(a << 12) | (b << 6) | c] for (a, b, c), x in brute_vector(p).items()) + model.bias for p in toxicity.pieces_of(w)) for w in units])
        want = model.probability(toxicity.document_features(scores, np.array(list(units.values())))[None, :])[0]
        assert got[r["doc_id"]] == pytest.approx(want, abs=1e-4)
    again = toxicity.score_toxicity(docs.unionByName(docs), model).groupBy("doc_id").agg(F.countDistinct("score").alias("n"), F.count("*").alias("m")).collect()
    assert all(r["n"] == 1 and r["m"] == 2 for r in again)


def test_toxicity_edges(spark):
    docs = edges(spark).select("doc_id", "text", F.lit("s").alias("score"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.report(docs, none).collect()
    assert len(got) == 10 and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    marks = spark.createDataFrame([(i * 7 - 3, i % 2) for i in range(9)] + [(4, None), (11, 1)], "doc_id long, toxic int")
    got = toxicity.report(docs, marks).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.report(docs.limit(0), marks).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        if name == "toxicity":
            want = {r["doc_id"] for r in docs.collect() if toxicity.score_texts([r["text"]], model)[0] < 0.5}
            assert {r["doc_id"] for r in got.collect()} == want
        elif name == "near_duplicates":
            from tests.llm.test_minhash import brute

            assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, _, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if i == c)
        elif name == "pii":
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            after = {r["doc_id"]: r for r in got.collect()}
            assert all(r["text"] == pii.redact_text(before[i]) and r["n_chars"] == len(r["text"]) for i, r in after.items())
            assert before.keys() == after.keys() and any(before[i] != r["text"] for i, r in after.items())
        elif name == "mixing":
            assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert got.count() <= 1.6 * docs.count() + 20
        else:
            assert got.count() == docs.count() and got.columns == ["doc_id", "n_tokens", "ids"]
            break
        assert got.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(got.collect(), got.schema)
    four = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (None, "x y"), (None, "x y"), (3, None), (3, ""), (5, "p q"), (5, "r s"), (5, "r s")]], "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.STAGES[1][1](spark, four, sf)
    assert one.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=str) == sorted([(1, "a b c d e f"), (None, "x y"), (3, None), (3, ""), (5, "p q"), (5, "r s")], key=str)
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", None, "s", 0, 1), (1, "", None, "s", 0, 1)], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, sf).count() >= min(1, rows.count())
    assert corpus_pipeline.run(spark, sf).count() > 100
