import pytest
from pyspark.sql import functions as F

from tidemark.llm import lookalikes, pages
from tidemark.llm import text as X


@pytest.mark.parametrize("raw,clean,kinds", [
    ("Ｖaccine №", "Vaccine No", {"compat"}), ("a​b­c﻿", "abc", {"invisible"}), ("a b　c", "a b c", {"space"}), ("KH‑71", "KH-71", {"hyphen"}),
    ("été", "été", {"marks"}), ("バ", "バ", {"marks"}), ("“x” – y — é", "“x” – y — é", set()), ("👩‍🔬 ok", "👩‍🔬 ok", set()),
    ("承認（速報）、発売！", "承認（速報）、発売！", set()), ("plain", "plain", set()), ("", "", set()),
])
def test_fold(raw, clean, kinds):
    assert X.fold(raw) == (clean, kinds)


def test_mixed_tokens_and_repair():
    assert X.mixed_tokens("Вaramijаquin Регулятор TGFβ IFN-γ сказал") == [("Вaramijаquin", "Baramijaquin", True)]
    assert X.repair("TNFα", set()) == "TNFα"
    assert X.repair("pαnel", {"panel"}) == "panel"
    assert X.repair("Xedelonοnor", set()) == "Xedelononor"


def test_dominant_script():
    assert X.mixed_tokens("сахаp") == [("сахаp", "сахар", False), ("сахаp", "caxap", False)]
    assert X.repaired("сахаp", set()) == ("сахаp", False, False)
    assert X.repaired("сахаp", {"сахар", "caxap"}) == ("сахар", False, False)
    assert X.repaired("Росhе", {"poche"}) == ("Poche", True, False)
    assert X.repaired("контрoль", {"контроль"}) == ("контроль", False, False)
    assert X.repaired("оf сell", {"of"}) == ("of cell", True, True)


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, t string, s string").selectExpr("*", "'clash' as id", "'clash' as value", "array('x') as kinds")


def test_operator_nulls_repeats_clashes_long(spark):
    long = "word " * 50_000 + "ѕite"
    rows = [(1, "plain", None), (2, "", "a b"), (3, "сell", "pαnel of pαnels"), (3, "сell", "pαnel of pαnels"), (4, long, "the panel"), (5, "TNFα", "Цена"), (None, "сell", "a b")]
    got = {(r.id, r.field): (sorted(r.kinds), r.clean) for r in lookalikes.repaired(table(spark, rows), "k", ["t", "s"]).collect()}
    assert set(got) == {(2, "s"), (3, "t"), (3, "s"), (4, "t")}
    assert got[2, "s"] == (["space"], "a b") and got[3, "t"] == (["lookalike", "unproven"], "cell")
    assert got[3, "s"] == (["lookalike"], "panel of pαnels") and got[4, "t"][1].endswith("word site")
    every = lookalikes.consistent(table(spark, rows), "k", ["t", "s"])
    assert every.count() == 9
    assert lookalikes.repaired(table(spark, []), "k", ["t", "s"]).count() == 0


def test_columns_agree_with_functions(spark):
    texts = ["Plain Text", "Ｆull", "сell", None, "", "ÉTÉ “q”", "Регулятор", "TGFβ", "a\tb"]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.comparable_column(F.col("t")).alias("c")).collect()]
    assert [g.replace("\t", " ") if g else g for g in got] == [None if t is None else X.comparable(t) for t in texts]


@pytest.mark.parametrize("a,b", [
    ("http://www.X.example:443/news/1.html#top", "https://x.example/news/1.html"), ("https://x.example/n%65ws/1.html", "https://x.example/news/1.html"),
    ("https://go.hub.example/click?c=1&url=https%3A%2F%2Fm.x.example%2Fa%252Db%3Futm_source%3Dq&mkt=en", "https://x.example/a-b"),
    ("https://x.example/i.php?sid=1&cat=l&p=5&UTM_Source=z", "http://x.example/i.php?p=5&cat=l"), ("https://x.example/a/", "https://x.example/a"),
])
def test_same_page(spark, a, b):
    assert pages.page_key(a) == pages.page_key(b) is not None
    got = spark.createDataFrame([(a,), (b,)], "u string").select(pages.page_key_column(F.col("u")).alias("k")).collect()
    assert got[0].k == got[1].k == pages.page_key(b)


def test_other_pages_and_nothing():
    assert pages.page_key("https://x.example/i.php?p=5") != pages.page_key("https://x.example/i.php?p=6")
    assert pages.page_key(None) is None and pages.page_key("  ") is None and pages.page_key("http://[bad") == "http://[bad"


def test_suspect_wherever_something_is_found(spark):
    looks = sorted(X.LOOKALIKE)
    texts = ["journé\u0435", "anné\u0435", "pequeñ\u043e", "añ\u043e", "\u0430é", "aカ\u043e", "\u043e漢字a"]
    texts += [f"é{c}" for c in looks] + [f"{c}ñ" for c in looks] + [f"x{c}" for c in looks]
    texts += [chr(o) for o in range(0x80, 0x3200)] + [chr(o) for o in range(0xF900, 0x10000)]
    need = {t for t in texts if X.fold(t)[1] or X.fold(t)[0] != t or X.mixed_tokens(t)}
    assert set(texts[:7]) <= need
    got = spark.createDataFrame([(t,) for t in texts], "t string").filter(X.suspect(F.col("t"))).collect()
    assert need <= {r.t for r in got}
