import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import text as X
from tidemark.llm import words as W


def plain(text):
    return [] if text is None else [w.lower() for w in re.findall(r"[^\W_]+", text)]


@pytest.mark.parametrize("piece", [1 << 20, 7, 50])
def test_words_of_a_column(monkeypatch, piece):
    monkeypatch.setattr(W, "PIECE", piece)
    rnd = random.Random(1)
    rows = [None, "", " "] + ["".join(rnd.choice("abc XYZ 12 é ß Ж 漢 字 の-_.,\n𝒳 ") for _ in range(rnd.randrange(60))) for _ in range(500)]
    v, n = W.hashed(pa.array(rows))
    assert n.tolist() == [len(plain(t)) for t in rows]
    seen = {}
    for w, h in zip([w for t in rows for w in plain(t)], v.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert W.hashed(pa.array(rows).slice(5, 100))[1].tolist() == n.tolist()[5:105]


def test_nothing_and_very_long():
    assert W.hashed(pa.array([], pa.string()))[1].tolist() == []
    assert W.hashed(pa.array([None, None], pa.string()))[1].tolist() == [0, 0]
    assert W.hashed(pa.array(["a " * 3_000_000, "漢" * 1_000_000]))[1].tolist() == [3_000_000, 1]


def test_suspects_equal_the_column_form(spark):
    rnd = random.Random(2)
    chars = "ab Zé" + "оаβνо" + "カ漢" + "’–…" + "\u200b\u00a0" + "Ｆ𝒳" + ".,"
    rows = [None, "", "plain"] + ["".join(rnd.choice(chars[: rnd.choice([5, 12, 14, len(chars)])]) for _ in range(rnd.randrange(9))) for _ in range(3000)]
    rows += [chr(o) for o in range(0x80, 0x3200)] + [f"a{chr(o)}" for o in range(0x80, 0x600)]
    got = W.suspects(pa.array(rows)).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    assert got == [r.s for r in df.orderBy("i").select(X.suspect(F.col("t")).alias("s")).collect()]
    assert any(got) and not all(got)


def test_comparables():
    rows = [None, "Plain", "Ｆull", "сell", "“q”"]
    assert [t and t.lower() for t in W.comparables(pa.array(rows)).to_pylist()] == [None, "plain", "full", "cell", "“q”"]
    assert W.comparables(pa.array([None], pa.string())).to_pylist() == [None]
