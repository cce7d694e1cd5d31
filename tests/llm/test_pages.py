import html as entities
import random
import re
import time
from collections import Counter, defaultdict
from urllib.parse import urlsplit

from paperloom.llm import pages


def deduced(rows):
    """Texts, with the occurrence vectors written out. rows: (url, html)"""
    hosts = defaultdict(list)
    for url, page in rows:
        host = urlsplit(url).hostname if url else None
        if host and page is not None and (tokens := pages.parsed(page)[1]):
            hosts[host].append(tokens)
    out = {}
    for host, sequences in hosts.items():
        n = len(sequences)
        counts = [Counter(t.hash for t in s) for s in sequences]
        classes = defaultdict(list)
        for t in set().union(*counts):
            classes[tuple(c[t] for c in counts)].append(t)
        known, chars = {}, Counter()
        for k, (vector, tokens) in enumerate(classes.items()):
            support = sum(v > 0 for v in vector)
            orders = {tuple(sorted(tokens, key=[t.hash for t in s].index)) for s, c in zip(sequences, counts) if c[tokens[0]]}
            if n >= pages.PAGES and support >= max(pages.PAGES, pages.SHARE * n) and len(tokens) > 1 and len(orders) == 1:
                known |= {t: (k, support) for t in tokens}
                if max(vector) == 1:
                    for t in (t for s in sequences for t in s if t.hash in tokens and t.container):
                        chars[t.hash] += t.text
        large = [(v, t) for t, v in chars.items() if 2 * v > max(chars.values())]
        out[host] = pages.Template(known, min(large)[1] if large else None)
    return [pages.main_text(page, out.get(urlsplit(url).hostname if url else None, pages.NO_TEMPLATE)) for url, page in rows]


def page(k, host="a.example", extra=""):
    return (
        f"http://{host}/p{k}",
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='has-sidebar'><nav><a href='/{k}'>Menu {k}</a></nav>"
        f"<div class=\"siteHeader\">Head {k}</div><article><h1>Title &amp; {k}</h1><p>First  of\n{k}<br>same block<p>Second {k} &lt;b&gt;</p><div>Read all our articles today</div>"
        f"<p class='tag'>Tagged everywhere</p>{extra}<div id='comments'><p>Nice {k}!</p></div></article><aside>Side {k}</aside><form>Mail {k}</form><footer>&copy; {k}</footer>",
    )


def test_template(spark):
    rows = [page(k, extra="<p>Only some</p>" if k < 3 else "") for k in range(8)] + [page(k, "b.example") for k in range(2)]
    df = spark.createDataFrame([(k, u, h, "x", 1) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r.text for r in pages.report(df).collect()}
    assert got[0] == "Title & 0\nFirst of 0 same block\nSecond 0 <b>\nOnly some"
    assert got[5] == "Title & 5\nFirst of 5 same block\nSecond 5 <b>"
    assert got[8] == "Title & 0\nFirst of 0 same block\nSecond 0 <b>\nRead all our articles today\nTagged everywhere"
    assert [got[k] for k in range(len(rows))] == [t for t, _ in deduced(rows)]


def unnamed(k, host="n.example", lang="en"):
    """A page whose boilerplate has no telling name, and its article as a reader would mark it."""
    r = random.Random(k)
    paragraphs = [" ".join(r.choice("one two three four five six seven".split()) for _ in range(r.randint(20, 60))) + f" {k}" for _ in range(r.randint(2, 5))]
    article = [f"Story {k}", *paragraphs]
    body = f"<h2>{article[0]}</h2>" + "".join(f"<p>{x}</p>" for x in paragraphs)
    return (
        f"http://{host}/{k}",
        f"<html lang={lang}><body><div id=u1><div>Top story {k + 1}</div><div>Weather {k % 40} degrees</div></div><div id=u2><div id=u3>{body}</div><div id=u4><p>Reader {k}: {r.random()} is wrong</p></div></div>"
        f"<div id=u5>Buy now {r.random()}</div><div id=u6>Page {k}, since 1999</div></body></html>",
    ), "\n".join(article)


def test_no_telling_names(spark):
    """Where names tell nothing, the template decides; without one all the page's text is taken."""
    made = [unnamed(k) for k in range(30)] + [unnamed(k, "few.example") for k in range(3)]
    rows = [(k, u, h) for k, ((u, h), _) in enumerate(made)]
    got = {r.page_id: (r.text, r.decided) for r in pages.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == (made[k][1], "template") for k in range(30))
    assert all(got[k][1] == "names" and got[k][0] != made[k][1] for k in range(30, 33))
    assert [got[k] for k in range(33)] == deduced([(u, h) for _, u, h in rows])


def marked(html):
    """The article of one of the given pages, read with expressions only."""
    inner = re.search("(?s)<article>(.*)</article>", html)[1]
    blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split("</?(?:p|h1)>", inner)]
    return "\n".join(x for x in blocks if x)


def test_given_pages(spark):
    """The articles of the given pages, also if nothing but the template is there to tell them: elements and names made all the same."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    want = {i: marked(h) for i, _, h in rows}
    plain = [(i, u, re.sub(r"<(/?)(?:nav|footer|article)>", r"<\1div>", re.sub('(<div) class="ad"', r"\1", h))) for i, u, h in rows]
    plain = [(i, u, re.sub("(<div)(?=>)", lambda m, n=iter(range(9)): f"<div id=d{next(n)}", h)) for i, u, h in plain]
    for made in (rows, plain):
        got = {r.page_id: (r.text, r.decided) for r in pages.report(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
        decided = [i for i in want if got[i][1] == "template"]
        assert len(decided) > 0.95 * len(rows)
        assert all(got[i][0] == want[i] for i in decided)


def test_linear():
    """Odd pages take time in proportion to their length."""
    def took(x):
        start = time.perf_counter()
        pages.parsed(x)
        return time.perf_counter() - start

    for unit in ("<b>", "<p a='", "<!", "<a><p>", "<ul><li>", "<p a='>", "<script", "<table><tr><td>", "< ", "<b><p>x</b>"):
        once, more = (min(took(unit * (n // len(unit))) for _ in range(2)) for n in (100_000, 800_000))
        assert more < 8 * 3 * max(once, 0.01), unit

def test_odd_pages(spark):
    rows = [(None, None), ("http://c.example/", None), ("http://c.example/", ""), ("::", "<p>x"), (None, "plain & text"), ("http://c.example/1", "<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>"), ("http://c.example/1", "<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>")]
    rows += [("http://c.example/2", "<main><p>in</main><p>out"), ("http://c.example/3", '<div class="ad">ad</div><p title="a>b">kept</p><!-- <p>no</p> --> <script>"'), ("http://c.example/4", "<p>" + "word " * 50_000), ("http://c.example/5", "a < b &eacute;&#x4e2d;"), ("http://c.example/6", "<p a='" * 2000)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.report(df).collect()}
    assert [got[k][0] for k in range(9)] == ["", "", "", "x", "plain & text", "a\nb\nc\nd\ne\nf", "a\nb\nc\nd\ne\nf", "in", "kept"]
    assert got[9][1] == 249_999 and got[10][0] == "a < b é中"
    assert pages.report(df.where("page_id > 99")).count() == 0


def test_nesting():
    assert pages.nested([(0, 1), (1, 2), (2, 2), (3, 1)], {1: 9, 2: 8}) == {1, 2}
    assert pages.nested([(0, 1), (1, 2), (2, 1), (3, 2)], {1: 9, 2: 8}) == {1}
    assert pages.nested([(0, 2), (1, 1), (2, 1), (3, 2)], {1: 9, 2: 8}) == {1, 2}


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = df.collect()
    got = {r.page_id: r for r in pages.report(df).collect()}
    want = [t for t, _ in deduced([(r.url, r.html) for r in rows])]
    assert [got[r.page_id].text for r in rows] == want
    assert all(got[r.page_id].n_chars == len(t) for r, t in zip(rows, want))
