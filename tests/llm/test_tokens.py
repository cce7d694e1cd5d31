import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from paperloom.llm import tokens

FOLDER = tokens.TOKENIZERS


class Plain:
    """Token bytes and ids by the libraries themselves, whole texts at a time."""

    def __init__(self):
        self.a = Tokenizer.from_file(f"{FOLDER}/{tokens.FIRST}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{tokens.SECOND}")
        vocab = json.load(open(f"{FOLDER}/{tokens.FIRST}", encoding="utf-8"))["model"]["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in shown]
        code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.bytes_a = {i: bytes(code[c] for c in p) for p, i in vocab.items() if p != "<|endoftext|>"}

    def both(self, text):
        if not text:
            return [], []
        raw = (" " + text).encode()
        a = [(i, self.bytes_a[i]) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == raw else ([], [])


def spans(tokens_):
    out, at = [], 0
    for i, x in tokens_:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows):
    plain, docs, counts = Plain(), [], Counter()
    for doc, text in rows:
        a, b = map(spans, plain.both(text))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for e in ends:
            groups.append([[i for i, s, t in side if low <= s and t <= e] for side in (a, b)])
            low = e
        links, j = [], 0
        for i, s, t in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < t:
                links.append((i, b[k][0]))
                k += 1
        counts.update(links)
        docs.append((doc, len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc, n_a, n_b, groups, links in docs:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


TEXTS = [
    None, "", " ", "  ", "a", "a ", " a", "a  b ", "foo\n bar \n baz\t\tqux  x", "the ▁ sign", "<|endoftext|> <s> </s> <unk> <0x0A>",
    "don't we'll Straße élève 日本語テキスト 한국어 emoji 🙂🙃 mixed", "nul \x00 byte", "same same same", "same same same", "x" * 500, "12345 67,890.12", "ünïcödé　space   em",
]


def test_small(spark):
    rows = [(k if k % 5 else None, t) for k, t in enumerate(TEXTS)] + [(1, "a")]
    docs = spark.createDataFrame([(d, t, 1, 2, "r") for d, t in rows], "doc_id long, text string, n_a int, row int, pair string")
    assert rows_of(tokens.report(docs)) == brute(rows)


def test_empty(spark):
    assert rows_of(tokens.report(spark.createDataFrame([], "doc_id long, text string"))) == []


@pytest.mark.parametrize("chunk,fan", [(48, 2), (100, 3), (1000, 16)])
def test_chunks(spark, chunk, fan):
    """Texts cut into many chunks, within words and at them, one of them without any space, have the tokens, groups and links of whole texts."""
    rng = random.Random(chunk)
    words = "the of Straße élève naïve tokenisation 日本語テキスト don't 12,345 a\nb ▁ 🙂🙃 internationalisation\t- ...  ! antidisestablishmentarianism".split(" ")
    long = [" ".join(rng.choice(words[:-1]) for _ in range(n)) for n in (30, 200, 400)]
    rows = [(k, t) for k, t in enumerate([*long, *(t.replace("▁", "_") for t in long), "日本語テキスト" * 60, "abc def ".replace(" ", "") * 90 + " end", "y" * 300 + " ", *TEXTS])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert rows_of(tokens.report(docs, chunk=chunk, fan=fan)) == want
    assert rows_of(tokens.report(docs, chunk=chunk, fan=fan, pairs=40)) == want
    assert rows_of(tokens.report(docs, chunk=chunk, fan=fan, pairs=0)) == want


def test_composition():
    """Fragments compose to the same whatever neighbours are composed first."""
    rng = random.Random(5)

    def fragment(k):
        closed = k == 0 or rng.random() < 0.6
        part = lambda: bytes(rng.randrange(256) for _ in range(2 * rng.randrange(1, 4)))
        return {"row": 1, "doc_id": 7, "k": k, "first": k, "closed": closed, "ok": True, "a": part() if k else b"", "b": part() if k else b""} | {x: part() if closed else None for x in ("suf_a", "suf_b")}

    def folded(items, order):
        parts, items = [], list(items)
        for at in order:
            at %= len(items) - 1
            total, closed = tokens.composed(items[at], items[at + 1])
            parts += [closed] if closed else []
            items[at : at + 2] = [total]
        return items[0], sorted(parts, key=lambda p: p["part"])

    for _ in range(50):
        items = [fragment(k) for k in range(9)]
        assert folded(items, [0] * 8) == folded(items, [7, 6, 5, 4, 3, 2, 1, 0]) == folded(items, [rng.randrange(100) for _ in range(8)])


def test_long_words():
    """Words of a million characters, and white space, are taken in time."""
    for text in ("a" * 1_000_000, "x" + " " * 1_000_000, "日" * 200_000, "ab1" * 300_000):
        a, b = tokens.tokenizers(FOLDER).encode([text])[0]
        assert len(a) and len(b)


def test_given(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(tokens.report(docs, chunk=4096)) == brute([(r.doc_id, r.text) for r in docs.collect()])
