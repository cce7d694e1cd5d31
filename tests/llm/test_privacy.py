import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

from paperloom.llm import privacy


def luhn(d):
    s = [int(c) for c in d[::-1]]
    return (sum(s[::2]) + sum(sum(divmod(2 * c, 10)) for c in s[1::2])) % 10 == 0


def base(text):
    """The patterns as they are stated."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


TEXTS = [
    None, "", "no data", "a@b.c@d.e x..y+z@h-1.co.uk@@q.r", "@a.b a@b a@.b a@b..c é@ü.de", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1..2.3.4.5 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111", "+49 (30) 1234-567 +1 +12 +123456789012345678 ++1 222 333 444", "北京 +1 (743) 555-3824 x 227.5.221.1 é mail: A.b@C.de.",
    "9" * 4000 + ".1.2.3 " + "a" * 3000, "a@b.co 1.1.1.1" * 20, "+1 555 123 4567 4111 1111 1111 1111", "a%b@c.d-e.f_g@h.i",
]


def test_base(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in privacy.report(docs).collect())
    want = []
    for i, t, _ in rows:
        spans = base(t or "")
        n = Counter(s[0] for s in spans)
        want.append((i, *(n[k] for k in privacy.KINDS), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
    assert got == sorted(want)
    clean = {r.doc_id: r.text for r in privacy.sanitised(docs, support=99).collect()}
    assert clean[0] is None and clean[2] == "no data"
    assert clean[8].endswith("mail: [EMAIL].")
    assert privacy.sanitised(docs).columns == docs.columns and privacy.sanitised(docs).count() == len(rows)
    assert {r.doc_id: r.text for r in privacy.report(docs).collect()}[2] == "no data"


def test_long(spark):
    docs = spark.createDataFrame([(1, "a" * 300_000), (2, "1" * 300_000), (3, "1 " * 100_000), (4, "+1" + "(" * 200_000), (5, "a@" * 100_000)], "doc_id long, text string")
    assert {r.n_card + r.n_ip + r.n_email for r in privacy.report(docs).collect()} == {0}


def test_empty(spark):
    assert privacy.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def secret(text):
    """Strings of 20 characters or more, of letters and digits, and varied."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+_]+(={0,2})", text):
        n = Counter(m[0])
        share = [sum(v for c, v in n.items() if c in chars) / len(m[0]) for chars in ("0123456789", string.ascii_letters)]
        if len(m[0]) - len(m[1]) >= 20 and min(share) >= 0.15 and sum(-v / len(m[0]) * math.log2(v / len(m[0])) for v in n.values()) >= 3:
            if not any(s < m.end() and m.start() < e for _, s, e in base(text)):
                out.append(("secret", *m.span()))
    return out


def words(text):
    """Terms and their places: words of letters, three bytes or more, outside the spans."""
    taken = base(text) + secret(text)
    for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text):
        if len(m[0].encode()) >= 3 and not re.search("[0-9]", m[0]) and all(m.end() <= s or m.start() >= e for _, s, e in taken):
            yield re.sub("[A-Z]", lambda x: x[0].lower(), m[0]), *m.span()


def protected(text):
    out = set()
    for kind, s, e in base(text) + secret(text):
        v = text[s:e]
        out |= {kind, f"{kind}:{v.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', v)}"}
        if kind == "email":
            out |= {f"name:{x}" for x in re.findall("[a-z]{3,}", v.split("@")[0].lower())}
    return out


def disclosing(texts, support=privacy.SUPPORT):
    """{term: largest share} over all entities, counted plainly."""
    pairs, holders, df = Counter(), Counter(), Counter()
    for t in texts:
        own, found = {w for w, _, _ in words(t or "")}, protected(t or "")
        df.update(own)
        holders.update(found)
        pairs.update((e, w) for e in found for w in own)
    out = defaultdict(float)
    for (e, w), n in pairs.items():
        if n >= support and holders[e] < len(texts):
            p, z, m = n / df[w], privacy.SURE, df[w]
            low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            share = math.log(low * len(texts) / holders[e]) / math.log(len(texts) / holders[e])
            if share >= privacy.GENERALISE:
                out[w] = max(out[w], share)
    return out


def spans_of(text, told):
    """All spans as the query writes them."""
    found = base(text) + secret(text) + [("term", s, e) for w, s, e in words(text) if w in told]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def planted():
    """Agent Zorblax goes with one number, Quux with the emails of one name, marker words with secrets; the names also stand in documents without these."""
    r = random.Random(5)
    common = ["plain", "words", "number", "here", "with", "some", "other", "call", "about", "Straße", "día"]
    texts = [" ".join(r.choice(common) for _ in range(12)) for _ in range(4000)]
    for k in range(30):
        texts[k] += " call agent Zorblax at +1 (743) 555-3824"
        texts[100 + k] = "Quuxian says: " + texts[100 + k] + " " * 400 + f"and more, jane.doe.{k}@mail{k % 3}.example.org"
        texts[200 + k] += ' apitoken = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'
    texts[500] += " Zorblax here, with quuxian"
    texts[501] += " Zorblaxian isn't the word"
    return texts


def test_terms(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    told = disclosing(texts)
    assert {"zorblax", "agent", "quuxian", "says", "apitoken"} <= set(told) and not {"plain", "words", "straße"} & set(told)
    for listed in (privacy.LISTED, 1):  # in one block, and in several; by a list, and without
        found = privacy.found(docs, privacy.disclosures(docs, listed=listed), ["doc_id"], listed=listed).collect()
        for r in found:
            assert [(t["start"], t["end"], t["remove"]) for t in r.terms] == [(s, e, told[w] >= privacy.REMOVE) for w, s, e in words(texts[r.doc_id]) if w in told]
    got = {r.doc_id: r for r in privacy.report(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k].spans == spans_of(t, told) and got[k].n_spans == len(got[k].spans.split(",")) * (got[k].spans != "")
    assert got[3000].text == texts[3000] and got[501].n_spans == 0 and got[500].n_terms == 2
    for k, word in ((5, "Zorblax"), (105, "Quuxian"), (205, "apitoken"), (500, "Zorblax")):
        assert word not in got[k].text
    assert "3824" not in got[5].text and "jane" not in got[105].text and got[205].n_secrets == 1 and "[SECRET]" in got[205].text


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    told = disclosing([r.text for r in rows])
    assert "token" in told
    got = {r.doc_id: r for r in privacy.report(docs).collect()}
    for r in rows:
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in base(r.text or ""))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[r.doc_id].spans == spans_of(r.text or "", told)


def test_many_entities(spark):
    """A text of a thousand addresses and twenty thousand words, alone and in three copies, is paired piece by piece; pairs are as counted one by one."""
    def text(k):
        return " ".join(f"user{n}.of{k}@mail{n % 50}.org " + " ".join(f"word{chr(97 + (k + n) % 26)}{chr(97 + w)}{chr(97 + n // 40)}" for w in range(20)) for n in range(1000))

    rows = [(k, text(k)) for k in range(4)]
    found = privacy.pair_counts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), support=3)
    kinds = {privacy.code("email"), privacy.code("name:user"), privacy.code("name:mail")}
    assert {r.entity for r in found.select("entity").distinct().collect()} <= kinds
    copies = [(k, text(0)[:20_000]) for k in range(3)]
    small = privacy.pair_counts(spark.createDataFrame(copies, "doc_id long, text string").coalesce(1), support=3)
    known = privacy.entities(copies[0][1], privacy.base_spans(copies[0][1]))
    each = small.groupBy("entity").count().collect()
    assert len(each) == len(known) and len({r["count"] for r in each}) == 1 and small.where("n <> 3").count() == 0
