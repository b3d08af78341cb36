import html
import re

import pytest
from pyspark.sql import functions as F

from garimpo.functions import text as X
from garimpo.operators import quality as Q

GOOD = (
    "A história da ciência no Brasil começou com a chegada de naturalistas que vieram estudar as florestas e os rios. "
    "Depois disso, muitas escolas foram criadas nas cidades do litoral e também no interior, onde os professores ensinavam "
    "matemática, física e biologia para os jovens que queriam aprender mais sobre o mundo."
)


def one(spark, column, *values):
    schema = ", ".join(f"c{i} {'boolean' if isinstance(v, bool) else 'string'}" for i, v in enumerate(values))
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def reason(spark, text, is_pt=True):
    return one(spark, Q.rejection_reason(F.col("c0"), F.lit(is_pt)), text)


def test_cascade_reports_the_first_failing_test(spark):
    assert reason(spark, GOOD) is None
    assert reason(spark, None) == reason(spark, "") == reason(spark, "curto") == "length"
    assert reason(spark, "a b ## " * 60) == "alpha_density"
    assert reason(spark, "\n".join([GOOD[:200]] * 2 + [GOOD[100:300]])) == "line_repetition"
    assert reason(spark, "um dois tres quatro cinco " * 10) == "ngram_repetition"
    assert reason(spark, " ".join(f"palavra{i} outra{i}" for i in range(40))) == "pt_stopwords"
    assert reason(spark, " ".join(f"palavra{i} outra{i}" for i in range(40)), False) is None


def test_ratios(spark):
    c = F.col("c0")
    assert one(spark, Q.alpha_density(c), "abcdef#####") == pytest.approx(6 / 11)
    assert one(spark, Q.repeated_line_share(c), "a\nb\nA \nc") == 0.5
    assert one(spark, Q.repeated_line_share(c), "a") == 0.0
    assert one(spark, Q.repeated_ngram_share(c), "a b c d e " * 10) == pytest.approx(1 - 5 / 46)
    assert one(spark, Q.stopword_count(c), "o gato e a Casa de pedra") == 3
    for e in (Q.repeated_line_share(c), Q.repeated_ngram_share(c)):
        assert one(spark, e, "") == 0.0


def slow_clean(t):
    t = re.sub(r"<(script|style)[\s\S]*?</\1>", "", t, flags=re.I)
    t = re.sub(r"<[^>]+>", " ", re.sub(r"<!--[\s\S]*?-->", "", t))
    t = html.unescape(t).replace(" ", " ")
    t = re.sub(r"!\[.*?\]\(.*?\)", "", re.sub(r"\[!\[.*?\]\(.*?\)\]\(.*?\)", "", t))
    t = "\n".join(re.sub(r"[^\S\r\n]+", " ", x).strip() for x in t.splitlines())
    return re.sub(r"\n{3,}", "\n\n", t).strip()


@pytest.mark.parametrize(
    "t",
    [
        "<p>Olá&nbsp;<b>mundo</b></p><script>x()</script>\n\n\n\n<!-- a\nb -->fim &amp; &eacute; &#233;",
        "[![b](u)](v) texto ![i](u)\r\noutra \t linha terceira\x0bquarta",
        "  ",
        "a < b e c > d",
    ],
)
def test_cleaning_equals_the_stepwise_version(spark, t):
    assert one(spark, X.clean_boilerplate(F.col("c0")), t) == slow_clean(t)


def test_word_functions(spark):
    c = F.col("c0")
    assert one(spark, X.whitespace_words(c), "a b\x1cc　 d") == ["a", "b", "c", "d"]
    assert one(spark, X.word_tokens(c), "Inteligência_1 ½x!") == ["inteligência_1", "½x"]
    assert one(spark, X.n_grams(X.whitespace_words(c), 2), "a b c") == ["a b", "b c"]
    assert one(spark, X.n_grams(X.whitespace_words(c), 5), "a b") == ["a", "b"]
    assert one(spark, X.char_shingles(X.normalize(c)), "Ab  cDef") == ["ab cd", "b cde", " cdef"]
    assert one(spark, X.char_shingles(X.normalize(c)), "") == []
    assert one(spark, X.keyword_score(c, F.array(F.lit("a"), F.lit("zz"))), "A longa resposta") == 1.0


@pytest.mark.parametrize(
    "flag,name,want",
    [(None, "pt_web", True), (None, "x_PT", True), (None, "a_pt_b", True), (None, "en_edu", False), (None, "opt_benchmarks", False), (None, "python_scripts", False), (None, "src0", True), (False, "pt", False)],
)
def test_language_flag(spark, flag, name, want):
    d = spark.createDataFrame([(flag, name)], "f boolean, s string")
    assert d.select(X.resolve_is_pt(F.col("f"), F.col("s"))).first()[0] is want


def test_legacy_filter(spark):
    c, pt = F.col("c0"), F.lit(True)
    assert one(spark, Q.legacy_quality(c, pt), GOOD) is True
    for bad in (None, "", "curto", GOOD + "!" * 9, " ".join(["@@@@ a"] * 60), "\n".join(["a mesma linha de novo aqui"] * 10), " ".join(f"x{i}" for i in range(80))):
        assert one(spark, Q.legacy_quality(c, pt), bad) is False, bad
