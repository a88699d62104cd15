import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity, text

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def apply(spark, values, *columns):
    return [tuple(r)[1:] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", *columns).orderBy("i").collect()]


@pytest.mark.parametrize(("given", "wanted"), [
    ("  São Paulo: 12-13 ", "saopaulo12 13"), ("Vol. 12 / 3", "vol12 3"), ("1a2 3", "1a2 3"), ("A  1  2  B", "a1 2b"), ("10 (2) 3", "10 2 3"), ("--9--", "9"),
    ("COVID-19", "covid19"), ("Ørsted 7", "rsted7"), ("½ cup", "cup"), ("Zeta//@//alpha//@//Alpha ", "alphazeta"), ("//@//", ""), ("", ""), (None, None),
])
def test_normalize(spark, given, wanted):
    assert apply(spark, [given], text.normalize(F.col("x"))) == [(wanted,)]


def test_normalize_equals_the_loop_over_characters(spark):
    rnd = random.Random(1)
    values = ["".join(rnd.choice("aB1 2-é:Ü,\t9ñ") for _ in range(rnd.randrange(30))) for _ in range(500)]

    def loop(x):
        flat = unicodedata.normalize("NFD", x.strip("".join(map(chr, range(33)))).lower())
        chars = [c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in flat]
        out = ""
        for i, c in enumerate(chars):
            if c != " ":
                if out and out[-1].isdigit() and c.isdigit() and i and chars[i - 1] == " ":
                    out += " "
                out += c
        return out

    assert [r[0] for r in apply(spark, values, text.normalize(F.col("x")))] == [loop(v) for v in values]


def test_limit_size(spark):
    long = ALPHABET * 6
    got = apply(spark, [long[:100]], text.limit_size(F.col("x"), 90), text.limit_size(F.col("x"), 200))
    assert got == [("abcdefghijklmnopqrstuvwxyzabcdjklmnopqrstuvwxyzabcdefghijklmstuvwxyzabcdefghijklmnopqrstuv", long[:100])]
    assert apply(spark, [long[:130]], text.limit_size(F.col("x"), 100)) == [("abcdefghijklmnopqrstuvwxyzabcdefgwxyzabcdefghijklmnopqrstuvwxyzabcdtuvwxyzabcdefghijklmnopqrstuvwxyz",)]


def test_lists_and_joins(spark):
    got = apply(spark, ["Zé, A//@//b//@// b", "x"], text.normalize_list(F.col("x")), text.join_trimmed(F.split("x", text.OCCURRENCE)), text.order_occurrences(F.col("x")))
    assert got == [(["b", "b", "zea"], "Zé, A,b,b", "Zé, A//@//b"), (["x"], "x", "x")]
    assert apply(spark, ["a,b,,", None], text.count_char(F.col("x"), ",")) == [(3,), (0,)]
    assert apply(spark, ["a | b|| ", "||"], text.split_columns(F.col("x")), text.split_fields(F.col("x"))) == [(["a", "b"], ["a", "b", "", ""]), ([""], ["", "", ""])]


def test_grams(spark):
    got = apply(spark, ["vol12 3", "vol12 3abcd", "ab", ""], text.index_grams(F.col("x")), text.query_grams(F.col("x")))
    assert got[0] == (["vol", "ol1", "l12", "12 ", "2 3"], ["vol"])
    assert len(got[1][0]) == 9 and got[1][1] == ["vol", "3ab"]
    assert got[2:] == [([], []), ([], [])]
    assert apply(spark, ["abcdef"], text.query_grams(F.col("x"), double_pass=True)) == [(["abc", "def", "cde"],)]


def test_unescape_needs_the_semicolon(spark):
    got = apply(spark, ["a &lt;b&gt; &amp; &#65;&#x42; &lt &nosuch; &eacute;", "plain", None], text.unescape_html(F.col("x")))
    assert got == [("a <b> & AB &lt &nosuch; é",), ("plain",), (None,)]


PAIRS = [
    ("abcdef", "abcdef", 1.0, 1.0), ("abcdef", "abcdeg", 0.944444, 0.8), ("abcdef", "xbcdef", 0.694444, 0.8), ("night", "nacht", 0.566667, 0.25),
    ("contextfree", "contextfreegrammar", 0.611111, 0.740741), ("dengueinbrazil2019", "dengueinbrasil2019", 0.944444, 0.882353), ("ab", "abc", 0.666667, 0.666667),
    ("ab", "ab", 1.0, 1.0), ("", "a", 0.0, 0.0), ("", "", 1.0, 0.0),
]


def test_golden_similarities(spark):
    sims = similarity.ngram_similarities([p[0] for p in PAIRS], [p[1] for p in PAIRS])
    assert np.allclose(sims, [p[2] for p in PAIRS], atol=1e-6)
    rows = spark.createDataFrame([(i, p[0], p[1]) for i, p in enumerate([*PAIRS, ("gg", "gggggggg", 0, 0.25)])], "i int, a string, b string")
    got = [r[0] for r in rows.orderBy("i").select(similarity.dice(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, [*[p[3] for p in PAIRS], 0.25], atol=1e-6)
    sets = [r[0] for r in rows.orderBy("i").select(similarity.dice_sets(F.col("a"), F.col("b"))).collect()]
    assert sets[0] == 1 and sets[3] == 0.25 and np.isnan(sets[9])


def scalar(s, t, n=3):
    if not s or not t:
        return float(not s and not t)
    if min(len(s), len(t)) < n:
        return sum(a == b for a, b in zip(s, t)) / max(len(s), len(t))
    a, b = "\0" * (n - 1) + s, "\0" * (n - 1) + t
    d = [float(i) for i in range(len(s) + 1)]
    for j in range(1, len(t) + 1):
        new = [float(j)]
        for i in range(1, len(s) + 1):
            x, y = a[i - 1 : i - 1 + n], b[j - 1 : j - 1 + n]
            wrong = sum(p != q for p, q in zip(x, y)) / (n - sum(p == q == "\0" for p, q in zip(x, y)))
            new.append(min(new[-1] + 1, d[i] + 1, d[i - 1] + wrong))
        d = new
    return 1 - d[-1] / max(len(s), len(t))


def test_similarity_properties():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc1 é") for _ in range(rnd.randrange(25))) for _ in range(300)]
    a, b = words[:150], words[150:]
    got, back = similarity.ngram_similarities(a, b), similarity.ngram_similarities(b, a)
    assert np.allclose(got, [scalar(x, y) for x, y in zip(a, b)], atol=1e-5)
    assert np.allclose(got, back, atol=1e-5)
    assert all(0 <= s <= min(len(x), len(y)) / max(len(x), len(y), 1) + 1e-6 for s, x, y in zip(got, a, b) if x or y)


def test_similarities_from_a_floor_on_fill_less_of_the_table():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh12") for _ in range(rnd.randrange(60, 91))) for _ in range(120)]
    near = []
    for w in words:
        t = list(w)
        for _ in range(rnd.randrange(25)):
            t[rnd.randrange(len(t))] = rnd.choice("abc")
            if rnd.random() < 0.3:
                del t[rnd.randrange(len(t))]
        near.append("".join(t))
    left, right = words + words + ["ab", "", "abc", "a"], near + words[1:] + words[:1] + ["abc", "", "abc", "b"]
    similarity.Cells.computed = 0
    full = similarity.ngram_similarities(left, right)
    cells, similarity.Cells.computed = similarity.Cells.computed, 0
    for floor in (0.3, 0.7, 0.9):
        similarity.Cells.computed = 0
        got = similarity.ngram_similarities(left, right, floor=floor)
        assert np.array_equal(got, np.where(full >= np.float32(floor), full, np.float32(0)))
        assert similarity.Cells.computed < {0.3: 1.01, 0.7: 0.5, 0.9: 0.25}[floor] * cells


def test_authors(spark):
    rows = [(["silvaj"], ["silvaj", "souza"], True), (["silvaj", "xxxx"], ["silvaj", "souza"], False), (["silvaj", "xxxx"], ["silvaj"], True), ([], ["a"], True), ([""], [""], True), (None, None, True)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>, agree boolean").withColumn("got", similarity.authors_agree(F.col("a"), F.col("b")))
    assert all(r.got == r.agree for r in got.collect())  # in the third none is left to disagree


def test_functions_in_sql(spark):
    from kindred.functions import sql

    sql.register(spark)
    words = ["  São Paulo: 12-13 ", "Vol. 12 / 3", "Zeta//@//alpha//@//Alpha ", "", None, "//@//", "\tÉ 1 2", "gg", "gggggggg", "night", "nacht"]
    df = spark.createDataFrame([(i, w, words[-1 - i]) for i, w in enumerate(words)], "i int, a string, b string")
    df.createOrReplaceTempView("two_words")
    got = spark.sql("SELECT i, normalize_text(a) AS n, dice_similarity(a, b) AS d, ngram_similarity(a, b) AS s FROM two_words").orderBy("i").collect()
    want = df.select("i", text.normalize(F.col("a")).alias("n"), similarity.dice(F.col("a"), F.col("b")).alias("d"), similarity.ngram_similarity(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    assert got == want and got[0].n == "saopaulo12 13"
