"""The training-data operators against brute-force versions, round trips and odd inputs."""

import collections
import hashlib

import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from lodestar.llm import embeddings, fingerprint, html, language, mixing, ngram_join, packing, pii, quality, urls
from lodestar.llm.common import connected_components, most_frequent, read
from lodestar.llm.registry import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n", "a", "A b", "x " * 30_000, "é" * 5, "e\u0301" * 5, "word word word word word word", "word word word word word word", "日本語 テスト", "a\u00a0b\x1cc\x85d"]


def components_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- shared pieces


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 340)] + [(350, k) for k in range(351, 400)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of(400, links)
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_most_frequent_is_bounded(spark):
    df = spark.createDataFrame([(i, 1 + i // 50) for i in range(1000)], "k long, n long")
    got = [r.n for r in most_frequent(df, "n", "k", 120).collect()]
    assert len(got) <= 150 and min(got) >= 17
    assert most_frequent(df, "n", "k", 5000).count() == 1000


# ---------------------------------------------------------------- 1 pages


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("<p>a &amp; b</p>", "a & b"), ("plain", "plain"),
        ("<nav>n</nav><header>h</header><article><h1>T</h1><p>one <b>two</b><br>three<p>four</article><footer>f</footer>", "T\none two three\nfour"),
        ("<div class='ad'>x</div><main><p>a</p><aside>s</aside><form>f</form><div id=comments>c</div></main>", "a"),
        ("<article>a<script>var t='</p>'</script><style>p{}</style>b<!-- c --></article>", "a b"),
        ("<article><ul><li>a<li>b</ul>c</article>", "a\nb\nc"),
        ("<article><p>open <i>italic", "open italic"),
        ("<div class=menu>m<article><p>a</p></article>", "a"),
        ("<article><p>a&nbsp; b&#33;\n c</p></article>", "a b! c"),
        ("<body><div>x</div><div class='sidebar'>y</div></body>", "x"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(html.parse(page)[0]) == want


@pytest.mark.parametrize(
    "inner,want",
    [
        ("<div title='a hidden gem'><p>two</p></div>", "two"), ('<p data-x="role=navigation class=ad">two</p>', "two"), ("<p it's>two</p><p>it's</p>", "two\nit's"),
        ("<div class='article-header'><h2>two</h2></div>", "two"), ("<div class='market-share'>two</div><p id=social-history>three</p>", "two\nthree"),
        ("<p>x <math><mi>two</mi></math></p>", "x two"), ("<label>two</label>", "two"), ("<object><p>two</p></object><canvas>three</canvas><noscript>four</noscript><map>five</map>", "two\nthreefourfive"),
        ("<header><h1>two</h1></header>", "two"), ("<div class='x ad y'>gone</div><section id=comments>gone</section>two", "two"), ("<form><label>gone</label></form>two", "two"),
        ("<div class=header>two</div>", "two"), ("</div></section></b>two", "two"), ("<div hidden>gone</div><div style='display: none'>gone</div>two", "two"),
    ],
)
def test_articles_are_whole(inner, want):
    assert html.main_text(html.parse(f"<body><nav>n</nav><article>{inner}</article></body>")[0]) == want


def test_long_and_broken_pages_are_linear():
    import time

    def took(n):
        pages = ["<div>" * n + "</b>" * n + "</x>" * n, "<div>t" * n, "<div>t</div>" * n, "<a \"" * n, "<p '=" * n, "<ul><li>x" * n, "<article>" + "<div>x " * n + "</article>", "<!--" * n, "<td><p>x" * n]
        began = time.process_time()
        for page in pages:
            blocks, trees = html.parse(page)
            html.main_text(blocks, [t[:2] for t in trees])
        return time.process_time() - began

    took(500)
    assert took(16_000) < 12 * took(4_000) + 0.5


def brute_levels(h, page):
    """Subtrees of a page as (start, end, (level, name, subtree), in the article): host, and domain and all hosts for small ones outside of articles."""
    blocks, trees = html.parse(page)
    every = sum(len(b[1]) for b in blocks)
    for a, b, t, inside in trees:
        small = 2 * sum(len(x[1]) for x in blocks if a <= x[0] < b) < every
        for level, name in enumerate((h, ".".join(h.split(".")[-2:]), "")[: 3 if small and not inside else 1]):
            yield a, b, (level, name, t), inside


def brute_templates(pages):
    """Keys of (level, host, subtree) that recur, by a plain count over all pages."""
    held, main = collections.defaultdict(set), collections.defaultdict(set)
    for _, u, page in pages:
        h = re.search(r"://([^/?#]*)", u or "")
        h = h[1].lower() if h else ""
        text = html.main_text(html.parse(page)[0])
        main[h].add(text)
        for _, _, k, inside in brute_levels(h, page):
            held[k, inside].add(text)
    least = lambda k, inside, n: (10 if inside and 2 * n < len(main[k[1]]) else 5, 10, 20)[k[0]]
    return {k for (k, inside), texts in held.items() if len(texts) >= least(k, inside, len(texts))}


def test_templates_by_brute_force(spark):
    rng = random.Random(6)
    parts = ["<div>about us {}</div>", "<section><p>read more {}</p><p>now</p></section>", "<ul><li>tip {}<li>tip</ul>", "<p>said {}</p>"]
    pages = []
    for i in range(500):  # one hot host, a few small ones; inner blocks recur on 5 to 40 % of its pages
        h = "hot.org" if i % 3 else f"s{i % 9}.org"
        inner = "".join(rng.choice(parts).format(rng.randrange(2 if j else 12)) for j in range(rng.randrange(4)))
        outer = rng.choice(parts).format("out")
        pages.append((i, f"http://{h}/{i}", f"<body>{outer}<article><h1>t{i % 480}</h1>{inner}<p>body {i % 480}</p></article></body>" if i % 4 else f"<body>{outer}{inner}<p>only {i}</p></body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    known = brute_templates(pages)
    assert len(known) > 10
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    for i, u, page in pages:
        h = u.split("/")[2]
        assert got[i] == html.main_text(html.parse(page)[0], [(a, b) for a, b, k, _ in brute_levels(h, page) if k in known])
        assert f"{'body ' + str(i % 480) if i % 4 else 'only ' + str(i)}" in got[i]
    assert any("read more" in page and "read more" not in got[i] for i, _, page in pages if i % 3 and i % 4)


def test_templates_are_removed_by_host(spark):
    menu = "<div><p>Home</p><p>About us</p></div>"
    pages = [(i, f"http://a.org/{i}", f"<html><body>{menu}<section><p>text {i} of this page</p></section></body></html>") for i in range(8)]
    pages += [(100 + i, f"http://b.org/{i}", f"<html><body>{menu if i == 0 else ''}<p>other {i}</p></body></html>") for i in range(8)]
    pages += [(200 + i, "http://c.org/x", "<body><div><p>same</p></div><p>copy</p></body>") for i in range(9)]  # copies of one page are no template
    pages += [(300, None, None), (301, "nonsense", "<p>x</p>")]
    df = spark.createDataFrame([(*p, "mine") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got[3] == "text 3 of this page" and got[100] == "Home\nAbout us\nother 0" and got[205] == "same\ncopy" and got[300] == "" and got[301] == "x"


def test_templates_page_by_page(spark, monkeypatch):
    pages = [(i, f"http://a.org/{i}", f"<body><div>menu</div><p>text {i}</p></body>") for i in range(8)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {r.page_id: r.text for r in html.extract(df).collect()}
    monkeypatch.setattr(html, "MAX_BROADCAST", 0)
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want and want[2] == "text 2"


def test_templates_decide_on_pages_without_names(spark, monkeypatch):
    """Menus and notices in plain ``div`` elements, no ``article``: only what recurs tells them from the story."""
    menu, note = "<div><a href=/>Home</a> <a href=/b>All our topics</a></div>", "<div><p>We use small files to make this better.</p></div>"
    story = lambda i: f"<div><h2>Story {i}</h2><p>Something new happened in place {i} and nobody knows why.</p></div>"
    pages = [(i, f"http://w{i % 3}.org/{i}", f"<html><body>{menu}{story(i)}{note}</body></html>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {i: f"Story {i}\nSomething new happened in place {i} and nobody knows why." for i in range(30)}
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want
    monkeypatch.setattr(html, "LEAST", 10**9)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all("small files" in got[i] and "topics" in got[i] for i in want)


def test_templates_of_small_hosts_come_from_wider_levels(spark):
    note = "<div><p>Share this page with all of your friends today.</p></div>"
    story = "<div><p>The same long story that many sites print word for word, as an agency sold it to all of them at once.</p></div>"
    pages = [(i, f"http://h{i}.com/", f"<body>{note}<div><p>Text number {i}, which is a good deal longer than the note above it is.</p></div></body>") for i in range(25)]
    pages += [(100 + i, f"http://k{i}.com/", f"<body>{story}<p>by {i}</p></body>") for i in range(25)]
    pages += [(200 + i, f"http://n{i}.one.com/", f"<body><div><p>One company, many names.</p></div><p>Page {i} of one of its sites, and it says something of its own.</p></body>") for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all("friends" not in got[i] and f"Text number {i}," in got[i] for i in range(25))
    assert all("agency" in got[100 + i] for i in range(25))  # a story is no template, however many sites carry it
    assert all("company" not in got[200 + i] for i in range(12))


def test_a_teaser_is_no_article():
    story = "".join(f"<div><p>Paragraph {i} of the story that fills the page from top to bottom.</p></div>" for i in range(5))
    page = f"<body><div><article><h3>teaser</h3></article></div><div>{story}</div></body>"
    assert html.main_text(html.parse(page)[0]) == "\n".join(f"Paragraph {i} of the story that fills the page from top to bottom." for i in range(5))
    links = "".join(f"<li><a href=/{i}>Another headline that is as long as any paragraph of the story</a>" for i in range(9))
    page = f"<body><ul>{links}</ul><article><p>Short news.</p></article></body>"
    assert html.main_text(html.parse(page)[0]) == "Short news."  # links are no running text


def test_no_pages(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_of_test_pages_are_whole(spark):
    """The generated pages hold one article each; its paragraphs must come out in order."""
    for r in QUERIES["op1_html_extraction"](spark, SF).join(read(spark, SF, "pages").select("page_id", "html"), "page_id").limit(60).collect():
        body = r.html[r.html.index("<article>") : r.html.rindex("</article>")]
        from html import unescape

        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


# ---------------------------------------------------------------- 2 vectors


def brute_vectors(rows, cosine=0.93):
    ok = [i for i, (_, e, lab) in enumerate(rows) if lab is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    links = []
    for a in ok:
        for b in ok:
            x, y = rows[a], rows[b]
            if a < b and x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = np.array(x[1], float), np.array(y[1], float)
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= cosine:
                    links.append((a, b))
    return links


@pytest.mark.parametrize("largest,bits", [(4096, 64 << 20), (7, 64 << 20), (7, 0)])
def test_vectors(spark, monkeypatch, largest, bits):
    for name, value in (("LARGEST", largest), ("BITS", bits)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        base = rng.standard_normal(16) if i % 4 == 0 or not rows else np.array(rows[-1][1]) + 0.12 * rng.standard_normal(16)
        rows.append((i, [float(np.float32(v)) for v in base], i // 60))
    rows += [(240, rows[0][1], 0), (241, [2 * v for v in rows[0][1]], 0), (242, rows[0][1], None), (243, None, 0), (244, [0.0] * 16, 0), (245, [1.0, None], 0), (246, [float("nan")] * 16, 0), (247, [], 1), (248, [1.0, 2.0], 0), (249, [float("inf")] + [1.0] * 15, 0)]
    links = brute_vectors(rows)
    degree, comp = collections.Counter(x for p in links for x in p), components_of(len(rows), links)
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(links) > 50
    assert sum(r.n_links for r in got.values()) >= 0.999 * 2 * len(links)
    assert all(got[i].n_links <= degree[i] for i in range(len(rows)))
    if all(got[i].n_links == degree[i] for i in range(len(rows))):
        assert [got[i].component_id for i in range(len(rows))] == comp
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[240].n_links == degree[240] and got[243].n_links == 0 and got[243].kept


def task_memory(rows, label_sizes, cosine=0.93):
    """Links of one part that holds all ``rows``, and the most memory (MB) that Python took for it."""
    import tracemalloc

    tracemalloc.start()
    found = embeddings.Found(rows, np.ones(len(rows), np.int64), np.zeros(len(rows), int), cosine)
    embeddings.join_caps(found, embeddings.CapCode(rows.shape[1], *embeddings.design(label_sizes, rows.shape[1], cosine)), 0, 1, False)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return found, peak


def test_tight_cluster_of_different_vectors():
    rng = np.random.default_rng(8)
    x = rng.standard_normal(64) + 0.1 * rng.standard_normal((5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, peak = task_memory(x, 5000)
    want = sum(int((x[i : i + 500] @ x.T >= 0.93).sum()) for i in range(0, 5000, 500)) - 5000
    assert found.links.sum() >= 0.999 * want and peak < 250 and len(set(found.root.tolist())) == 1


def test_many_vectors_in_two_labels(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((6000, 32))
    x = np.concatenate([base, base + 0.15 * rng.standard_normal(base.shape), base[:50].repeat(160, 0) + 0.18 * rng.standard_normal((8000, 32))]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = np.zeros(len(u), int)
    for lab in (0, 1):
        own = np.arange(lab, len(u), 2)
        for s in range(0, len(own), 500):
            want[own[s : s + 500]] = (u[own[s : s + 500]] @ u[own].T >= 0.93).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.998 * want.sum() > 10_000


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("n", [10**4, 10**6, 10**9])
def test_recall_by_design(n):
    """Pairs at the threshold share a filter of the design for ``n`` vectors."""
    bound, blocks, words = embeddings.design(n, 64)
    assert words <= embeddings.ALPHABET
    code, rng = embeddings.CapCode(64, bound, blocks, words), np.random.default_rng(1)
    a, b = rng.standard_normal((2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    held = [[set() for _ in a] for _ in range(2)]
    for own, x in zip(held, (a, b), strict=True):
        for r, c in zip(*code.decode(x), strict=True):
            own[r].add(c)
    assert sum(bool(x & y) for x, y in zip(*held, strict=True)) / len(a) >= 0.99
    assert sum(map(len, held[0])) / len(a) < 200


# ---------------------------------------------------------------- 3 personal data

EMAIL, IP, CARD, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_spans(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = lambda s: (lambda t: t % 10 == 0)(sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))))
    for k, (pattern, keep) in enumerate([(EMAIL, lambda s: True), (IP, lambda s: all(int(p) <= 255 for p in s.split("."))), (CARD, lambda s: 14 <= len(digits(s)) <= 19 and ok(digits(s))), (PHONE, lambda s: 10 <= len(digits(s)) <= 15)]):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if keep(m[0])]
    return sorted(out)


def test_base_spans_match_patterns():
    rng = random.Random(5)
    alphabet = "abZ09812345....@@@--+_% ()é\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(3000)]
    texts += ["4539 1488 0343 6467", "1.2.3.4.5.6.7.8 300.1.1.1", "+1 (555) 123-4567 x+49-30 1234567.", "a@b@c.de a.@b-.c", "éa@b.co", "0" * 16]
    for t in texts:
        assert [s[:3] for s in pii.scan(t) if s[1] < 4] == brute_spans(t)


def test_iban_and_context():
    t = "my bank account DE89 3704 0044 0532 0130 00, not DE88370400440532013000"
    assert [(pii.KINDS[k], t[s:e], x) for s, k, e, x in pii.scan(t) if k == 4] == [("iban", "DE89 3704 0044 0532 0130 00", 1.0)]


def test_long_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "a." * 100_000, "1." * 100_000, "+" * 200_000 + "1"):
        pii.scan(t)


def test_redact(spark):
    out = {r.doc_id: r.text for r in pii.redact(docs(spark, [None, "", "write to a@b.co now", "clean text 12"])).collect()}
    assert out == {0: None, 1: "", 2: "write to <EMAIL> now", 3: "clean text 12"}


def test_words_against_do_not_keep_base_spans(spark):
    texts = ["at the border office: +49 30 1234567", "in order to reach us dial +1 555 123 4567", "after conversion 10.0.0.1", "press release 10.0.0.1", "order serial isbn 4539 1488 0343 6467", "example a@b.co"]
    out = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert list(map(out.get, range(6))) == ["at the border office: <PHONE>", "in order to reach us dial <PHONE>", "after conversion <IP>", "press release <IP>", "order serial isbn <CARD>", "example <EMAIL>"]


def score_of(text, kind=None):
    return next(x for _, k, _, x in pii.scan(text) if kind is None or pii.KINDS[k] == kind)


def test_words_are_compared_whole_and_on_both_sides():
    phone, ip = "+49 30 1234567", "10.0.0.1"
    for t in (f"at the border office: {phone}", f"hotel {phone}", f"{phone} hotel", "b" + "order" + " " * 36 + phone, f"{phone}" + " " * 36 + "phone" + "s" * 9):
        assert score_of(t) == 0.6, t
    assert score_of(f"ship {ip}") == score_of(f"after conversion {ip}") == 0.6
    assert 0.75 < score_of(f"{phone} is my phone") < score_of(f"phone {phone}") == score_of(f"{phone} phone") <= 0.8
    assert 0.4 <= score_of(f"order: {phone}") < 0.41 and score_of(f"version {ip}") < 0.41
    assert score_of("tel order " + phone) < 0.6 < score_of("order tel " + phone)  # the nearer word counts more
    assert score_of("mail a@b.co") == 1.0 and score_of("a@b.co") == 0.9 and 0.9 < score_of("4539 1488 0343 6467 is my card") < 1


def test_ibans_of_all_countries():
    for country, size in pii.IBAN_LENGTH.items():
        body = ("7" * (size - 4))
        check = next(f"{i:02}" for i in range(2, 99) if pii.mod97(f"{country}{i:02}{body}"))
        t = f"konto {country}{check}{body}."
        assert [(s, e) for s, k, e, _ in pii.scan(t) if k == 4] == [(6, 6 + size)], country


def test_pii_of_odd_tables(spark):
    assert pii.redact(docs(spark, [])).count() == 0 and pii.pii_spans(docs(spark, [])).count() == 0
    df = docs(spark, ["mail a@b.co", "mail a@b.co", None]).unionAll(docs(spark, ["mail a@b.co"])).selectExpr("*", "1 as pii", "2 as kind", "3 as start")
    got = pii.pii_spans(df).collect()
    assert sum(len(r.pii) for r in got) == 3 and all((r.kind, r.start) == (2, 3) for r in got)
    assert sorted(str(r.text) for r in pii.redact(df).collect()) == ["None", *["mail <EMAIL>"] * 3]


def test_pii_query(spark):
    for r in QUERIES["op3_pii"](spark, SF).join(read(spark, SF, "documents").select("doc_id", "text"), "doc_id").collect():
        spans = brute_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]


def test_pii_spans_column(spark):
    r = pii.pii_spans(docs(spark, ["mail a@b.co"])).first()
    assert r.pii[0].kind == "email" and (r.pii[0].start, r.pii[0].end) == (5, 11)


# ---------------------------------------------------------------- 4 languages


def test_held_out_accuracy(spark):
    rows = language.identify(read(spark, SF, "documents")).join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_held_out_is_by_crc(spark):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in QUERIES["op4_language_id"](spark, SF).collect())


def test_languages_of_odd_texts(spark):
    texts = ["the cat and the dog"] * 8 + ["der Hund und die Katze"] * 8
    rows = [(i, t, "en" if i < 8 else "de") for i, t in enumerate(texts)] + [(100, None, "en"), (101, "123 !?", "de"), (102, "the " * 9000, None), (103, "d" * 500, None), (None, "der Hund", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[101].score == 0 and got[102].lang_pred == "en" and got[None].lang_pred == "de"


def test_words_of_code_switched_texts(spark):
    """Texts spliced from held-out documents of two languages: each word is labelled with its own language."""
    rows = [r for r in read(spark, SF, "documents").where("text is not null and lang is not null").select("doc_id", "text", "lang").collect()]
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and len(language.split(r.text)) >= 40]
    spliced, want = [], {}
    for i, (a, b) in enumerate((a, b) for k, a in enumerate(held[:40]) for b in held[k + 1 : k + 4] if a.lang != b.lang):
        x, y = language.split(a.text)[:15], language.split(b.text)[5:25]
        spliced.append((10_000_000 + i, " ".join([*x, *y]), None))
        want[10_000_000 + i] = [*[a.lang] * len(x), *[b.lang] * len(y)]
    df = spark.createDataFrame([*map(tuple, rows), *spliced], "doc_id long, text string, lang string")
    got = {r.doc_id: r.words for r in language.label_words(df).where("doc_id >= 10000000").collect()}
    hits = [w.lang == lang for i, langs in want.items() for w, lang in zip(got[i], langs, strict=True)]
    assert len(hits) > 500 and sum(hits) / len(hits) > 0.9
    assert all(0 < w.p <= 1 for ws in got.values() for w in ws)


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 40)
    names = [f"l{i:02}" for i in range(70)]
    rows = [(i, f"{names[i % 70] * 2}ka {chr(97 + i % 70 % 26) * 4}{chr(97 + i % 70 // 26) * 3}", names[i % 70]) for i in range(700)]
    rows += rows[:100]  # repeated rows
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 800 and len({r.lang_pred for r in got}) > 64


def test_numbers_are_no_letters():
    assert language.split("½ ² 12 Ⅷ") == [] and language.split("x² aé½b ßα") == ["x", "aé", "b", "ßα"]


def test_fit_predicts_like_a_plain_field():
    """Scores of label() against a plain forward-backward over the learned weights, word by word."""
    texts, labels = ["the cat and the dog", "der hund und die katze", "the dog", "die katze"] * 3, ["en", "de", "en", "de"] * 3
    model = language.fit(texts, labels)
    table = language._table(model)
    text = "the hund and katze zzz the"
    names, scores, each = language.label([text], model, table, True)
    emit = []
    for w in language.split(text):
        score = table[language.features(np.array([w]))[0]].astype(float).sum(0)
        emit.append(np.exp(np.maximum(score - score.max(), -30)))
    forward, backward = [model["start"] * emit[0]], [np.ones(2)]
    for e in emit[1:]:
        forward.append(forward[-1] @ model["move"] * e)
    for e in emit[:0:-1]:
        backward.insert(0, model["move"] @ (e * backward[0]))
    p = np.array([f * b / (f @ b) for f, b in zip(forward, backward, strict=True)])
    assert np.allclose([w[2] for w in each[0]], p.max(1), atol=1e-4)
    assert names[0] == model["names"][p.sum(0).argmax()] and scores[0] == pytest.approx(p.sum(0).max() / len(p), abs=1e-4)


def test_nothing_to_learn_from(spark):
    assert [r.lang_pred for r in language.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()] == ["und"]
    assert language.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    lengths, k = np.array([1, 4, 3]), 3
    chains = language.Chains(lengths)
    start, move = rng.random(k) + 0.1, rng.random((k, k)) + 0.1
    emit = rng.random((lengths.sum(), k)) + 0.1
    got, moves = chains.marginals(emit, start, move)
    total = np.zeros((k, k))
    first = np.concatenate([[0], np.cumsum(lengths[chains.by])])
    for rank, d in enumerate(chains.by):
        places = chains.place[first[rank] : first[rank + 1]]
        want, z, pairs = np.zeros((len(places), k)), 0.0, np.zeros((k, k))
        for path in itertools.product(range(k), repeat=len(places)):
            p = start[path[0]] * np.prod([emit[q, s] for q, s in zip(places, path, strict=True)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            z += p
            for t, s in enumerate(path):
                want[t, s] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        total += pairs / z
        assert np.allclose(got[places], want / z)
    assert np.allclose(moves, total)


# ---------------------------------------------------------------- 5 mixing


def test_mix_same_as_sql(spark, duck):
    same_rows(QUERIES["op5_mix_sources"](spark, SF), duck.execute(ORACLE_SQL["op5_mix_sources"]).df())


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mix_targets_and_takes(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(1, 40))), "en", rng.choice(["a", "a", "a", "a", "b", "c", None]), 0) for i in range(1500)] + [(9000, None, "en", "z", 0), (9001, "", "en", "a", 0), (None, "x y", "en", "b", 0)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 40
    assert len(got) == len(rows)


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_reruns_agree(spark):
    a, b = (sorted(map(tuple, QUERIES["op5_mix_sources"](spark, SF).select("doc_id", "taken").collect())) for _ in range(2))
    assert a == b


def test_mix_of_odd_tables(spark):
    """Clashing columns, one id in two sources, repeated rows, ties of size."""
    rows = [(i % 40, " ".join(["w"] * (1 + i % 5)), "en", f"s{i % 3}", 0) for i in range(120)] + [(7, "a b c", "en", "s1", 0)] * 3
    df = spark.createDataFrame(rows, DOCS)
    more = df.selectExpr("*", *(f"'{c}' as {c}" for c in ("size", "key", "s", "target", "taken", "copies", "_s", "_whole", "_cut", "_times", "_n", "w", "base")))
    plain, clash = (collections.Counter(map(tuple, mixing.mix(d).collect())) for d in (df, more))
    assert plain == clash and sum(plain.values()) == len(rows)
    got = mixing.repeat(more)
    assert got.columns == more.columns
    out = got.collect()
    assert all(r._s == "_s" and r.copies == "copies" for r in out)
    given, taken = collections.Counter(), collections.Counter()
    for i, t, _, s, _ in rows:
        given[s] += len(t.split())
    for r in out:
        taken[r.source] += len(r.text.split())
    want = brute_targets(given)
    assert all(abs(taken[s] - want[s]) <= 20 and taken[s] <= 2 * given[s] for s in given)


# ---------------------------------------------------------------- 6 packing


def check_packing(rows, encode, source):
    by, at = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        at[r.sequence_id].append((r.offset, r.length))
    for i, text in source.items():
        ids, own = [*encode(text or ""), 1], sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096)) and [r.piece for r in own] == list(range(len(own)))
        for r in own:
            part = ids[r.start : r.start + 4096]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    return len(at)


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = [*ODD, "don't STOP'st 's''s !!'s x²½ 12.5 naïve", "Привет мир's ΣΑΣ", "<|endoftext|> hi", "ﬁ İ"]
    df = docs(spark, texts)
    n = check_packing(packing.pack(df).collect(), lambda t: tok.encode(t, add_special_tokens=False).ids, dict(enumerate(texts)))
    assert n >= 30_000 // 4096


def test_packing_query(spark):
    rows = QUERIES["op6_best_fit_packing"](spark, SF).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    source = {r.doc_id: r.text for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    n = check_packing(rows, lambda t: tok.encode(t, add_special_tokens=False).ids, source)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    for size in (5, 60, 900):
        counts = collections.Counter(rng.randrange(1, 4097) for _ in range(size))
        used = collections.Counter()
        made = packing.plan(dict(counts))
        for chosen, times in made:
            assert sum(chosen) <= 4096 and times > 0
            for x in chosen:
                used[x] += times
        assert used == counts
        assert sum(t for _, t in made) <= 1.25 * sum(k * v for k, v in counts.items()) / 4096 + 2


def test_sum_index():
    """Pairs and triples that the index gives against all combinations, while lengths run out."""
    import random

    rng = random.Random(4)
    for _ in range(60):
        n = rng.choice([9, 24, 60])
        have = {x: rng.choice([1, 1, 2, 3]) for x in rng.sample(range(1, n + 1), rng.randint(1, n))}
        index = packing.SumIndex(have, n)
        while any(have.values()):
            for gap in range(1, n + 1):
                pairs = [(a, gap - a) for a in range(gap - 1, (gap - 1) // 2, -1) if have.get(a, 0) and have.get(gap - a, 0) > (2 * a == gap)]
                assert index.pairs[gap] == len(pairs) and index.pair(gap) == (pairs[0] if pairs else None)
                triples = [t for a in range(gap, 0, -1) for b in range(min(a, gap - a), 0, -1) if (t := (a, b, gap - a - b)) and 0 < t[2] <= b and all(have.get(x, 0) >= t.count(x) for x in t)]
                assert index.triple(gap) == (triples[0] if triples else None)
                assert index.single(gap) == ((gap,) if have.get(gap) else None)
            x = rng.choice([k for k, v in have.items() if v])
            k = rng.randint(1, have[x])
            index.take(x, k)
            have[x] -= k


def test_packing_alike_but_for_the_text(spark):
    """One id, or none, for different texts of one length: each piece has its own place."""
    words = ["river", "stone", "cloud", "field"]
    rows = [(key, " ".join(words[(n >> 2 * k) % 4] for k in range(6)), "en", "a", 9) for key in (None, 7) for n in range(200)]
    got = packing.pack(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 400 and len({(r.sequence_id, r.offset) for r in got}) == 400


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------- 7 fingerprints


def brute_canonical(t):
    nfc = lambda x: unicodedata.normalize("NFC", x)
    return re.sub(r"\s+", " ", nfc(nfc(t or "").casefold())).strip()


FOLDED = ["Straße", "STRASSE", "ΑΣ", "ας", "ασ", "ǅ", "ﬁn", "FIN", "ΐ", "İ"]


def test_fingerprints_group_by_canonical_text(spark):
    texts = [t for t in ODD if t is None or "\x1c" not in t] + ["Word  word\nword word word WORD", "É" * 5, *FOLDED]
    got = [(r.text, r.fingerprint) for r in fingerprint.fingerprint(docs(spark, texts)).collect()]
    for a, x in got:
        for b, y in got:
            assert (x == y) == (brute_canonical(a) == brute_canonical(b)), (a, b)


def test_buckets_are_compared_by_bytes(spark):
    df = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "a"), ("m", "c"), ("m", "c")], "key string, canon string")
    got = sorted((r.key, r.canon, r.ordinal) for r in fingerprint.resolve_buckets(df, "canon", "key").collect())
    assert got == [("k", "a", 1), ("k", "b", 2)]
    assert fingerprint.resolve_buckets(df.where("key = 'm'"), "canon", "key") is None


def brute_edited(source):
    """(id, text, edited text, next text) of (id, text) rows with different ids."""
    source = sorted((i, t or "") for i, t in source)
    for k, (i, t) in enumerate(source):
        n, follow = len(t) // 4, source[(k + 1) % len(source)][1]
        yield i, t, t[: len(t) - n] + follow[:n], follow


def check_edited(rows, source):
    got = {r.doc_id: r for r in rows}
    prints = collections.defaultdict(set)
    for i, t, new, follow in brute_edited(source):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.near_edited == float(brute_canonical(new) == brute_canonical(t)) == float(r.fingerprint == r.edited_fingerprint)
        assert r.near_next == float(brute_canonical(t) == brute_canonical(follow))
        prints[brute_canonical(t)].add(r.fingerprint)
        prints[brute_canonical(new)].add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len(set().union(*prints.values())) == len(prints)


def test_edited_texts(spark):
    check_edited(QUERIES["op7_document_fingerprints"](spark, SF).collect(), [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()])


def test_both_columns_are_numbered_by_one_bucket_table(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "DIGITS", 1)
    rng = random.Random(3)
    source = [(i, rng.choice(["", "a", "A ", "ab", "abc d", "a b c d", "aaaa", "AAAA bbbb", "b b b b"]) * rng.randrange(1, 3)) for i in range(60)]
    check_edited(fingerprint.with_edited(spark.createDataFrame(source, "doc_id long, text string")).collect(), source)


def test_next_of_one_and_of_none(spark):
    one = fingerprint.with_next(docs(spark, ["abc"])).collect()
    assert [r.next_text for r in one] == ["abc"]
    assert fingerprint.fingerprint(docs(spark, [])).count() == 0 and fingerprint.with_edited(docs(spark, [])).count() == 0


def test_fingerprints_keep_columns(spark):
    df = docs(spark, ["a b", "A  b", None]).selectExpr("*", "1 as _k", "2 as _b", "3 as _h", "4 as canon", "5 as digest", "6 as ordinal", "'x' as fingerprint")
    got = fingerprint.fingerprint(df).collect()
    assert len({r.fingerprint for r in got}) == 2 and all((r._k, r.canon, r.digest, r.ordinal) == (1, 4, 5, 6) for r in got)
    assert all((r._k, r._b, r._h) == (1, 2, 3) for r in fingerprint.with_next(df).collect())


def test_repeated_rows_and_null_ids_get_equal_fingerprints(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "X  y"), (2, None), (None, None)], "doc_id long, text string")
    got = fingerprint.with_edited(df).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.n_chars}) == 1 and len({r.fingerprint for r in got if not r.n_chars}) == 1


def test_next_of_hot_keys(spark):
    """A third of the rows has no id, a third shares one: both are cut by hash, and the order is that of (key, hash)."""
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i, f"text {i}" if i % 10 else "same") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    want = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.h, r.text) for r in hashed)
    follow = sorted((x[0], x[2], want[(i + 1) % len(want)][2]) for i, x in enumerate(want))
    made = fingerprint.with_next(df)
    got = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.text, r.next_text) for r in made.collect())
    assert got == follow


# ---------------------------------------------------------------- 8 shingles


def brute_shingles(texts):
    sets = []
    for t in texts:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, links


@pytest.mark.parametrize("entries,crowd", [(1 << 21, 2000), (300, 3)])
def test_shingle_components(spark, monkeypatch, entries, crowd):
    monkeypatch.setattr(ngram_join.product, "__defaults__", (entries,))
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv")
    passage = " ".join(word() for _ in range(60))
    texts = list(ODD)
    base = [word() for _ in range(120)]
    for _ in range(40):  # near copies of one text, from close to far
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randrange(3, 60)))}" for _ in range(40)]  # a passage that many share
    texts += [" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(30)] + texts[-5:]
    sets, links = brute_shingles(texts)
    want = components_of(len(texts), links)
    got = {r.doc_id: r for r in ngram_join.components(docs(spark, texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want


def test_shingles_of_the_test_documents(spark):
    rows = read(spark, SF, "documents").select("doc_id", "text").collect()
    at = {r.doc_id: k for k, r in enumerate(rows)}
    sets, links = brute_shingles([r.text for r in rows])
    comp = components_of(len(rows), links)
    low = {}
    for k, r in enumerate(rows):
        low[comp[k]] = min(low.get(comp[k], r.doc_id), r.doc_id)
    for r in QUERIES["op8_ngram_join"](spark, SF).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[at[r.doc_id]]), low[comp[at[r.doc_id]]])


def test_keep_one(spark):
    t = "one two three four five six seven eight nine ten"
    df = docs(spark, [t, t, None, None, "other words here", t + " eleven"]).unionAll(docs(spark, [t]))
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == [0, 2, 3, 4]


def test_keep_one_of_null_and_repeated_ids(spark):
    far = [" ".join(f"{w}{i}" for i in range(12)) for w in "abcdef"]
    near = [f"{t} more" for t in far]
    rows = [(None, far[0], "s0"), (None, far[1], "s0"), (None, near[1], "s1"), (None, "", "s0"), (1, far[2], "s0"), (1, far[2], "s0"), (2, far[3], "s0"), (2, far[4], "s1"), (3, near[2], "s0"), (1, near[4], "s0"), (None, far[5], "s0"), (7, near[5], "s0")]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS)
    got = collections.Counter((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect())
    one = [k for k in got if k in ((None, far[1]), (None, near[1]))]
    assert len(one) == 1
    assert got == collections.Counter([(None, far[0]), *one, (None, ""), (1, far[2]), (2, far[3]), (1, near[4]), (7, near[5])])


def test_mixed_rows_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    rows = [(None if i % 4 == 0 else i % 50, words(3 + i % 7, f"t{i}x"), "en", f"s{i % 4}" if i % 9 else None, 1) for i in range(240)] + [(None, " ", "en", "s1", 1)]
    df = spark.createDataFrame(rows, DOCS)
    size = lambda t: len(t.split())
    taken, given = collections.Counter(), collections.Counter()
    seen = collections.Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mixed_documents(spark, df, SF).collect())
    for r in rows:
        given[r[3]] += size(r[1])
        taken[r[3]] += size(r[1]) * seen[r[0], r[1], r[3]]
    assert max(seen.values()) <= mixing.PASSES and sum(seen.values()) == sum(r.copies for r in mixing.mix(df).collect())
    assert all(taken[s] <= 2 * given[s] for s in given)


def test_no_documents(spark):
    assert ngram_join.components(spark.createDataFrame([], DOCS)).count() == 0


# ---------------------------------------------------------------- 9 urls


def brute_rule(host, path):
    best = None
    for says, name, prefix in urls.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(prefix) and (best is None or len(name + prefix) > len(best[1])):
            best = (says, name + prefix)
    return best


def test_hosts_paths_rules(spark):
    given = [None, "", "nothing", "http://A.Example.NET/en/1?x#y", "https://example.net", "http://example.com/de/?q", "x://foo.org/fr/a", "http://badexample.net/", "http://h?p/q", "a://b://c/d", "http://org/fr/"]
    df = spark.createDataFrame([(i, u, "<title>some words here</title>") for i, u in enumerate(given)], "page_id long, url string, html string")
    for r in urls.judge(df).collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1]), r.url
        assert r.verdict == (rule[0] if rule else "block" if r.odds > np.log(urls.ODDS) else "allow")


def test_segmentation_is_the_best_of_all_splits(spark):
    import itertools

    counts = {"cheap": 30, "pills": 20, "the": 500, "he": 90, "ap": 3, "pill": 12, "s": 5}
    s = urls.Segmenter(counts, sum(counts.values()))
    for name in ("cheappills", "thecheap", "xqz", "thehe", ""):
        cost = lambda ws: sum(s.cost.get(w, s.unknown[len(w)]) for w in ws)
        splits = []
        for cuts in itertools.product([0, 1], repeat=max(len(name) - 1, 0)):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(name)]
            splits.append([name[a:b] for a, b in zip(at, at[1:]) if a < b])
        assert cost(s.split(name)) == pytest.approx(min(map(cost, splits)))
    names = spark.createDataFrame([("cheappills",), ("thecheap",), ("xqz",), ("z" * 200,)], "name string")
    got = {r.name: r.words for r in urls.segment(names, spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {n: s.split(n) for n in got} and len(got) == 4


def brute_judged(rows):
    """Verdicts and odds of (url, title) rows by plain counting."""
    counts = collections.Counter(w for _, t in rows for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if len(w) <= urls.LONGEST)
    for ws in urls.SEEDS.values():
        for w in ws:
            counts[w] = max(counts[w], urls.KNOWN)
    seg, skip = urls.Segmenter(counts, sum(counts.values())), set(urls.rule_tokens(urls.RULES))

    def tokens(h, p):
        out = [f"h:{w}" for name in re.findall(r"[^\W\d_]+", h) for w in seg.split(name)]
        return [t for t in out + ["p:0" if w.isdigit() else f"p:{w}" for w in re.findall(r"[^\W_]+", p.lower())] if t not in skip]

    parsed = []
    for u, _ in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        parsed.append((m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", ""))
    seen = {"allow": collections.Counter(), "block": collections.Counter({f"h:{w}": n for n, ws in urls.SEEDS.items() for w in ws})}
    for h, p in parsed:
        if h and (rule := brute_rule(h, p)):
            seen[rule[0]].update(tokens(h, p))
    known = set(seen["allow"]) | set(seen["block"])
    prior = sum(n * len(ws) for n, ws in urls.SEEDS.items())
    block, allow = sum(seen["block"].values()) + len(known), sum(seen["allow"].values()) + prior + len(known)
    odds = {t: np.log((seen["block"][t] + 1) / block) - np.log((seen["allow"][t] + 1) / allow) for t in known}
    for h, p in parsed:
        rule, x = brute_rule(h, p), sum(odds.get(t, 0.0) for t in tokens(h, p)) if h else 0.0
        yield x, rule[0] if rule else "block" if x > np.log(urls.ODDS) else "allow"


@pytest.mark.parametrize("frequent", [50_000, 20])
def test_verdicts_by_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(urls, "FREQUENT", frequent)
    rng = random.Random(12)
    words = ["green", "stone", "river", "garden", "house", "field", "cheap", "pills", "casino", "win", "spam", "farm", "lotto"]
    hosts = [rng.choice(words) + rng.choice(words) + rng.choice(["", "-" + rng.choice(words), "7"]) + "." + rng.choice(["example.net", "example.com", "site.org", "x.net", "de"]) for _ in range(60)]
    rows = [(f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'Shop'])}/{rng.choice(words)}-{rng.randrange(50)}?q", " ".join(rng.choices(words, k=4))) for _ in range(500)]
    rows += [(None, None), ("nothing", ""), ("http://LOTTO.com", "lotto Lotto"), *rows[:20]]
    df = spark.createDataFrame([(i, u, None if t is None else f"<title>{t}</title>", "mine", 7) for i, (u, t) in enumerate(rows)], "page_id long, url string, html string, odds string, _id int")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    want = list(brute_judged(rows))
    assert len(got) == len(rows) and len({v for _, v in want}) == 2
    for i, (x, verdict) in enumerate(want):
        assert got[i].odds == pytest.approx(x, abs=1e-6) and got[i].verdict == verdict and got[i]._id == 7, rows[i]


def test_spam_hosts_are_blocked(spark):
    hosts = [f"{a}{b}.example.com" for a in ("green", "stone", "river") for b in ("garden", "house", "field")] * 12 + ["cheappills.example.com", "casino-win.example.org", "spamfarm.example.com", "winfree.example.com"] * 5 + ["winhouse.example.com"]
    words = "green stone river garden house field the and of"
    df = spark.createDataFrame([(i, f"http://{h}/en/{i}", f"<title>{words}</title>") for i, h in enumerate(hosts)], "page_id long, url string, html string")
    verdicts = {r.host: r.verdict for r in urls.judge(df).collect()}
    assert {h for h, v in verdicts.items() if v == "block"} == {"cheappills.example.com", "casino-win.example.org", "spamfarm.example.com", "winfree.example.com"}


def test_words_of_blocked_sites_count_against_others(spark):
    hosts = ["lottoking.net"] * 60 + ["greenhouse.site.org"] * 60 + ["kinglotto.example.com", "greenking.example.com"]
    df = spark.createDataFrame([(i, f"http://{h}/fr/{i}", "<title>lotto king green house</title>") for i, h in enumerate(hosts)], "page_id long, url string, html string")
    verdicts = {r.host: r.verdict for r in urls.judge(df).collect()}
    assert verdicts["kinglotto.example.com"] == "block" and verdicts["greenhouse.site.org"] == verdicts["greenking.example.com"] == "allow"


def test_no_urls(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- 10 quality


def quality_tables(spark, n=400):
    rng = random.Random(4)
    words = [a + b for a in ("stone", "river", "light", "paper", "cloud", "field") for b in ("s", "ed", "ing", "er", "ly")]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 120)))
        kind = "toxic" if i % 9 == 0 else "junk" if i % 7 == 0 else "good"
        if kind == "toxic":
            text += " idiot you moron scum"
        if kind == "junk":
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 5:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[0] % 9 and r[0] % 7 for r in rows}


def test_quality_on_unlabelled_documents(spark):
    rows, labels, good = quality_tables(spark)
    got = {r.doc_id: r for r in quality.score(rows, labels).collect()}
    held = [i for i in got if i % 5 == 0]
    assert sum(got[i].kept == bool(good[i]) for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_pseudo_labels_of_all_unlabelled_documents(spark, monkeypatch):
    """What the pseudo-labels weigh follows the unlabelled documents, not the bound of the sample."""
    rows, labels, _ = quality_tables(spark, 1200)
    labels = labels.where("doc_id < 300")
    monkeypatch.setattr(quality, "SURE", 0.8)  # of so few labels no view is surer
    whole = quality.fit(rows, labels)["told"]
    monkeypatch.setattr(quality, "UNLABELLED", 100)
    part = quality.fit(rows, labels)["told"]
    assert max(whole) > 0.5 * 600 and all(0.7 * a < b < 1.4 * a for a, b in zip(whole, part, strict=True) if a > 50)


def test_quality_of_odd_documents(spark):
    rows, labels, _ = quality_tables(spark, 120)
    odd = spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(ODD)], DOCS)
    odd_labels = spark.createDataFrame([(1000, None, None), (5555, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(rows.unionAll(odd), labels.unionAll(odd_labels)).count() == 120 + len(ODD)


def test_without_labels_all_are_kept(spark):
    rows, labels, _ = quality_tables(spark, 30)
    assert quality.score(rows, labels.limit(0)).where("kept and score = 1.0").count() == 30
    assert quality.score(rows, labels.where("quality = 1 and toxic = 0")).where("kept").count() == 30
    assert quality.score(rows.limit(0), labels).count() == 0


def test_quality_keeps_columns(spark):
    rows, labels, _ = quality_tables(spark, 60)
    df = rows.selectExpr("*", "-5.0D as score", "'x' as kept", "1 as p_text", "2 as _p", "3 as bad", "4 as h")
    kept = quality.filter_good(df, labels)
    assert kept.columns == df.columns and all(r.score == -5.0 and r.kept == "x" and r._p == 2 for r in kept.collect())
    scored = quality.score(df, labels)
    assert scored.where("score between 0 and 1 and kept in (true, false)").count() == 60 and "bad" in scored.columns


def test_vocabulary_by_brute_force(spark):
    rows, labels, _ = quality_tables(spark, 300)
    told = quality.sample(rows, labels)
    have = told.select("text", "bad").collect()
    n = collections.Counter(r.bad for r in have)
    seen = collections.defaultdict(lambda: [0, 0])
    for r in have:
        for f in quality.text_features(r.text)[0]:
            seen[f][r.bad] += 1
    want = []
    for f, (g, b) in seen.items():
        total = n[0] + n[1]
        chi2 = total * (b * (n[0] - g) - g * (n[1] - b)) ** 2 / ((g + b) * (total - g - b + 0.5) * n[0] * n[1])
        if g + b >= quality.LEAST_DOCS and (b + 0.5) * n[0] / ((g + 0.5) * n[1]) >= quality.LEAST_ODDS and chi2 >= quality.LEAST_CHI2:
            want.append(f)
    assert quality.vocabulary(told) == sorted(want) and {"idiot", "moron", "scum"} <= set(want)


def test_scores_are_those_of_the_model(spark, monkeypatch):
    """Every document's score from the fitted weights, by plain sums; ties and repeated rows score alike."""
    rows, labels, _ = quality_tables(spark, 200)
    rows = rows.unionAll(rows.limit(20)).unionAll(docs(spark, [None, "", "idiot"]).selectExpr("doc_id + 5000", "text", "lang", "source", "n_chars"))
    models = []
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: models.append(real(*a)) or models[-1])
    got = quality.score(rows, labels).collect()
    m = models[0]
    line = lambda x, w: float(np.dot(x, w.w) + w.b)
    for r in got:
        own, n = quality.text_features(r.text)
        text = sum(m["weights"].get(f, 0.0) for f in own) + m["text"].b
        meta = line(quality.metadata(r.text, r.source or "", r.lang or "", sum(f[-1] != "-" for f in own) / n if n else 1.0), m["meta"])
        views = [line([text], m["scales"][0]), line([meta], m["scales"][1])]
        both = [min(8, max(-8, v)) for v in views]
        joint = line([*both, max(both)], m["joint"])
        for x, p in zip([*views, joint], (r.p_text, r.p_meta, r.score), strict=True):
            assert p == pytest.approx(1 - 1 / (1 + np.exp(-min(30, max(-30, x)))), abs=1e-9)
        assert r.kept == (r.score >= 0.5)


# ---------------------------------------------------------------- pipeline


def test_stages_by_brute_force(spark):
    """Each stage on its own input against plain code."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    rng = random.Random(21)
    base = read(spark, SF, "documents").limit(70).collect()
    given = [tuple(r) for r in base]
    for r in base[:25]:  # near and exact copies
        words = (r.text or "").split(" ")
        if len(words) > 30:
            words[rng.randrange(len(words))] = "changed"
            given.append((r.doc_id + 10**6, " ".join(words), r.lang, r.source, len(" ".join(words))))
        given.append((r.doc_id + 2 * 10**6, r.text, r.lang, r.source, r.n_chars))
    given += [(None, None, None, None, None), (7_777_777, "mail a@b.co or +49 30 1234567, card 4539 1488 0343 6467", "en", "s", 5)]
    df = spark.createDataFrame(given, read(spark, SF, "documents").schema)

    sets, links = brute_shingles([r[1] for r in given])
    comp = components_of(len(given), links)
    low = {}
    for k, r in enumerate(given):
        low[comp[k]] = min([*low.get(comp[k], []), r[0]], key=lambda i: (i is None, i)) if comp[k] not in low else min(low[comp[k]], r[0], key=lambda i: (i is None, i))
    want = sorted(str(r[0]) for k, r in enumerate(given) if not sets[k] or low[comp[k]] == r[0])
    kept = stages["ngram_jaccard_join"](spark, df, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == want

    masked = {(r.doc_id, r.source): r for r in stages["pii"](spark, df, SF).collect()}
    for i, t, _, s, _ in given:
        out, done = [], 0
        for start, kind, end in sorted({*brute_spans(t), *((a, k, b) for a, k, b, x in pii.scan(t) if k == 4 and x >= 0.5)}):
            if start >= done:
                out += [(t or "")[done:start], f"<{pii.KINDS[kind].upper()}>"]
            done = max(done, end)
        text = None if t is None else "".join([*out, t[done:]])
        assert masked[i, s].text == text and masked[i, s].n_chars == (None if text is None else len(text))

    taken = collections.Counter((r.doc_id, r.source) for r in stages["mixing"](spark, df, SF).collect())
    size, words = collections.Counter(), collections.Counter()
    for i, t, _, s, _ in given:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        size[s] += n
        words[s] += n * taken[i, s]
    longest = max(len((r[1] or "").split()) for r in given)
    assert all(abs(words[s] - x) <= longest for s, x in brute_targets(size).items()) and max(taken.values()) <= 2

    tok = Tokenizer.from_file(packing.tokenizer_path())
    check_packing(stages["best_fit_packing"](spark, df, SF).collect(), lambda t: tok.encode(t, add_special_tokens=False).ids, {r[0]: r[1] for r in given})

    good = {r.doc_id for r in quality.score(df, read(spark, SF, "labels")).where("score >= 0.5").collect()}
    assert {r.doc_id for r in stages["quality_classifier"](spark, df, SF).collect()} == good


def test_stages_keep_clashing_columns_and_take_empty_tables(spark):
    import corpus_pipeline

    names = ("copies", "_id", "_n", "_s", "_row", "score", "row", "k", "pii", "kept", "size", "length", "piece")
    df = docs(spark, ["one two three four five six", "one two three four five six", None, "", "mail a@b.co"]).selectExpr("*", *(f"'{c}' as {c}" for c in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        if name != "best_fit_packing":
            assert out.columns == df.columns, name
            assert all(r[c] == c for r in out.collect() for c in names), name
        assert stage(spark, df.limit(0), SF).count() == 0, name


def test_pipeline_stages(spark):
    import corpus_pipeline

    given = read(spark, SF, "documents")
    kept = given
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == given.columns, name
        rows = out.collect()
        sizes.append(len(rows))
        kept = spark.createDataFrame(rows, given.schema)
    assert 0 < sizes[1] <= sizes[0] < given.count() and sizes[2] == sizes[1]
    comp = ngram_join.components(kept.dropDuplicates(["doc_id"])).collect()
    assert all(r.doc_id == r.component_id or r.n_shingles == 0 for r in comp)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    assert sum(r.piece == 0 for r in pieces) == kept.count()


def test_pipeline_run(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 0


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    pages = [(1, "http://a.org/1", "<article><p>one</p></article>")] * 3 + [(None, None, "<p>two</p>"), (2, "http://a.org/1", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as _host", "2 as _templates", "3 as site", "4 as tree", "5 as host")
    assert sorted((str(r.page_id), r.text) for r in html.extract(df).collect()) == [("1", "one")] * 3 + [("2", ""), ("None", "two")]

    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1), (5, v, 1), (None, v, 1), (7, [1.0, 2.0, 3.01], 1), (8, v, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as h", "'y' as e", "'z' as dim")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    assert got == [("5", 3, 5), ("5", 3, 5), ("7", 3, 5), ("8", 0, 8), ("None", 3, 5)]

    texts = [(1, "one two three")] * 3 + [(None, None), (None, "x"), (2, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'a' as piece", "'b' as length", "'c' as salt", "'d' as rank")
    got = packing.pack(df).collect()
    assert len(got) == 6 and len({(r.sequence_id, r.offset) for r in got}) == 6 and {r.sequence_id for r in got} == {got[0].sequence_id}
    assert sorted(r.length for r in got)[:2] == [1, 1] and max(r.offset + r.length for r in got) == sum(r.length for r in got)

    df = spark.createDataFrame([(1, "one two three four five six", "s")] * 2 + [(None, "one two three four five six", "s"), (3, None, "s")], "doc_id long, text string, source string").selectExpr("*", "'a' as n", "'b' as k", "'c' as token", "'d' as row")
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.components(df).collect()) == [("1", 2, 1), ("1", 2, 1), ("3", 0, 3), ("None", 2, 1)]


def test_registry_names():
    assert [re.match(r"op(\d+)_", n)[1] for n in QUERIES] == [str(i) for i in range(1, 14)]




# ---------------------------------------------------------------- 4 and 10: what is learned from


def test_language_of_long_documents_is_learned(spark):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 8)))
    rows = [(i, " ".join(word("abcdefg") for _ in range(60)), "aa", None, None) for i in range(60)]
    rows += [(100 + i, " ".join(word("tuvwxyz") for _ in range(4000)), "xx", None, None) for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    assert max(len(r[1]) for r in rows) > 2 * language.LEARN_CHARS
    got = {r.doc_id: r.lang_pred for r in language.identify(df).collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_language_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(5)
    words = [["ab", "ba", "xy"], ["xy", "yx"], ["ab", "xx", "yy", "ba"]]
    states = [np.array([0, 0, 1]), np.array([1, 1]), np.array([0, 1, 1, 0])]
    told = language.Told(words, states, 2)
    used = np.unique(told.places[told.places > 0])
    weights = np.zeros((language.TABLE, 2), np.float32)
    weights[used] = rng.normal(size=(len(used), 2))
    start, move = rng.normal(size=2), rng.normal(size=(2, 2))

    def likelihood(weights, start, move):
        total = 0.0
        for own, gold in zip(words, states):
            emit = weights.astype(float)[language.features(np.array(own, str))].sum(1)
            path = lambda s: start[s[0]] + sum(emit[i, x] for i, x in enumerate(s)) + sum(move[a, b] for a, b in zip(s, s[1:]))
            every = [path(s) for s in np.ndindex(*[2] * len(own))]
            total += path(gold.tolist()) - np.log(np.exp(every).sum())
        return total

    gw, gs, gm = told.gradient(weights, start, move)
    step = 1e-3
    for at in [(int(used[0]), 0), (int(used[3]), 1), (int(used[-1]), 0)]:
        up, down = weights.astype(float), weights.astype(float)
        up[at] += step
        down[at] -= step
        assert abs((likelihood(up, start, move) - likelihood(down, start, move)) / (2 * step) - gw[at]) < 1e-3
    for k in range(2):
        moved = np.eye(2)[k] * step
        assert abs((likelihood(weights, start + moved, move) - likelihood(weights, start - moved, move)) / (2 * step) - gs[k]) < 1e-4
        for j in range(2):
            moved = np.zeros((2, 2))
            moved[k, j] = step
            assert abs((likelihood(weights, start, move + moved) - likelihood(weights, start, move - moved)) / (2 * step) - gm[k, j]) < 1e-4


def test_spliced_documents_teach_switches():
    words = [[f"a{i}" for i in range(60)], [f"b{i}" for i in range(10)], [f"c{i}" for i in range(40)]] * 4
    more, states = language.spliced(words, [0, 1, 2] * 4, 2.0, 25)
    assert len(more) == 12 + 24 and all(len(w) == len(s) for w, s in zip(more, states))
    assert all("abc".index(x[0]) == g for w, s in zip(more, states) for x, g in zip(w, s))
    assert sum(len(set(s.tolist())) > 1 for s in states[12:]) > 12
    alone, told = language.spliced(words[:1], [0])
    assert len(alone) == 1 and told[0].tolist() == [0] * 60


def test_code_switched_text_is_split_at_the_switch(spark):
    rows = read(spark, SF, "documents").where("lang is not null and length(text) between 200 and 3000").select("text", "lang").limit(150).collect()
    model = language.fit([r.text for r in rows], [r.lang for r in rows])
    weights = language._table(model)
    by = {}
    for r in rows:
        by.setdefault(r.lang, language.split(r.text)[:20])
    first, second = sorted(by)[:2]
    mixed = " ".join(by[first] + by[second])
    _, _, labelled = language.label([mixed], model, weights, True)
    right = [g == (first if i < len(by[first]) else second) for i, (_, g, _) in enumerate(labelled[0])]
    assert sum(right) >= len(right) - 4
    diagonal = np.diag(model["move"]).min()
    assert model["move"].max() == 1.0 and diagonal > 2 * max(model["move"][i, j] for i in range(len(model["names"])) for j in range(len(model["names"])) if i != j)


def test_quality_learns_from_long_documents(spark):
    bad, good = "scum trash " * 12_000, "fine words here " * 12_000  # all over LEARN_CHARS
    rows = [(i, (bad if i % 2 else good) + f"x{i}", "en", "s", None) for i in range(24)]
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, DOCS)
    chosen = quality.sample(df, labels)
    assert chosen.count() == 24 and chosen.where(f"length(text) > {quality.LEARN_CHARS}").count() == 0
