import json
import unicodedata

from pyspark.sql import functions as F

from paperloom.functions import unicode as U


def test_partial_string():
    raw = '{"explanation": "a\\n\\u00e9 \\ud83d\\ude00 b\\"c", "x": 1}'
    whole = json.loads(raw)["explanation"]
    last = ""
    for n in range(len(raw) + 1):
        text = U.partial_string(raw[:n], "explanation")
        assert whole.startswith(text) and len(text) >= len(last)
        last = text
    assert last == whole
    assert U.partial_string('```json\n{"explanation":"x', "explanation") == "x"
    assert U.partial_string('{"other":"x', "explanation") == U.partial_string(None, "explanation") == ""
    assert U.partial_string('{"explanation":"a\\q b', "explanation") == "a"


def test_self_source(spark):
    rows = [
        (0, "https://arxiv.org/abs/2005.11401v4", "", True), (1, "https://arxiv.org/abs/12005.114010", "", False), (2, "https://x.y/10.1%2Fab", "", True), (3, "https://x.y", "[2] A Long Enough Title - Site", True),
        (4, "https://x.y", "A Ｌong enough, title!", True), (5, "https://x.y", "A long", False), (6, None, None, False),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "k int, u string, t string")
    x = U.is_self_source(F.col("u"), F.col("t"), F.lit("2005.11401"), F.lit("10.1/ab"), F.lit("A long enough title"))
    assert {r.k: r.x for r in df.select("k", x.alias("x")).collect()} == {k: v for k, *_, v in rows}


def test_key_characters(spark):
    df = spark.createDataFrame([("aé½ ①-",), (None,)], "t string").select(U.key_characters(F.col("t")).alias("n"), U.title_key(F.col("t")).alias("k"))
    assert [tuple(r) for r in df.collect()] == [(4, "aé121"), (None, None)]


def test_key_characters_are_told_once(monkeypatch):
    text = "Ǆ ½ ﬁ aé-① İ ̈" * 50
    expected = sum(any(unicodedata.category(d)[0] in "LN" for d in unicodedata.normalize("NFKD", c)) for c in text)
    seen, plainly = [], unicodedata.normalize
    monkeypatch.setattr(U.unicodedata, "normalize", lambda form, c: seen.append(c) or plainly(form, c))
    assert U.kept_characters(text) == expected
    assert len(seen) <= len(set(text))
