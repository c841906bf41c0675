import random

import pytest

from tidemark.llm import truncation as T

BODY = "The study enrolled adults at several centres near the river. "


@pytest.mark.parametrize("tail,kind", [
    ("It ended well.", "sentence"), ("He said “fine.”", "sentence"), ("Both sides plan a joint...", "dots"), ("Both sides plan a [...]", "dots"), ("Both sides plan a joi", "open"),
    ("and therefore,", "open"), ("lots of &am", "broken"), ("lots of <a hre", "broken"), ("lots of caf�", "broken"), ("\n\nContact: press@x.example", "contact"),
    ("\nSource: https://x.example/media/1", "contact"), ("\n\nJane Roe\nHead of supply", "signature"), ("\n\n© 2026 X Newsroom", "copyright"), ("\n\n#kit #labnews", "tags"),
    ("\n– ends –", "mark"), ("\n###", "mark"), ("\n\n(Lyon, 1.9.2026)", "place"), ("\nRelated headlines:\n- Acme opens a site in Lyon\n- Acme hires", "list"), ("\nTel. +00 435 1907", "contact"),
])
def test_ending(tail, kind):
    assert T.ending(BODY + tail) == kind


@pytest.mark.parametrize("text", ['{"a": 1, "b": "x", "c": null}', "AA\tBB\t12.5\t99\nCC\tDD\t7\t8", "ACGT" * 50, "🚀🚀🚀", "=" * 80, "  ", "ok"])
def test_not_prose(text):
    assert not T.prose(text)


def test_rows_and_limits(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(300):
        text = (BODY + f"Tests on {k} samples from Lyon showed a gain over the older kit in most of the groups. ") * rnd.randrange(2, 9)
        if k % 3 == 0:
            text = "x" * (k % 50) + " " + text
            text = text[:500] if len(text) > 500 else text.strip()
        rows.append((k, text.strip() if len(text) != 500 else text, "hot"))
    rows += [(1000, None, "hot"), (1001, "", None), (1002, "ACGT" * 125, "hot"), (1003, BODY + "Both sides plan a joi", None), (1004, BODY * 30_000, "hot"), (1005, BODY + "Jane", "other"), (1003, BODY + "Both sides plan a joi", None), (None, BODY + "Both sides plan a joi", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as key", "2 as chars", "3 as ends", "4 as cut")
    got = {r.doc_id: r for r in T.truncated(df, "doc_id", "text", "source").collect()}
    cut = {k for k, t, _ in rows[:300] if len(t) == 500 and not t.rstrip().endswith(".")}
    assert cut and {k for k in got if k < 300 and got[k].cut} == cut
    assert all(got[k].at_limit and got[k].rule == "limit" for k in cut)
    assert got[1003].rule == "ending" and got[1000].rule is None
    assert [got[k].cut for k in (1000, 1001, 1002, 1003, 1004, 1005)] == [False, False, False, True, False, True]
    assert T.truncated(df.limit(0), "doc_id", "text", "source").count() == 0
