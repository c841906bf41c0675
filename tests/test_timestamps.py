import datetime as dt
import random

import numpy as np
import pytest

from tidemark.operators import timestamps as TS

AT = dt.datetime(2026, 3, 20, 12, 0, 0, 500000)
CASES = [
    ("2026-03-01T10:00:00Z", "a", "2026-03-01T10:00:00Z"), ("2026-03-01 10:00:00.999+0530", "a", "2026-03-01T04:30:00Z"),
    ("2026-01-05", "ny", "2026-01-05T05:00:00Z"), ("20260105", "ny", "2026-01-05T05:00:00Z"), ("  20251020T225047Z ", "ny", "2025-10-20T22:50:47Z"),
    ("1784442570", "ny", "2026-07-19T06:29:30Z"), ("1784442570427", "ny", "2026-07-19T06:29:30Z"), ("01/02/2026 10:00", "ny", "2026-01-02T15:00:00Z"),
    ("01/02/2026 10:00", "gb", "2026-02-01T10:00:00Z"), ("31.01.2026, 08:51 Uhr", "de", "2026-01-31T07:51:00Z"), ("Fri, 03 Jul 2026 17:13:08 PST", "de", "2026-07-04T01:13:08Z"),
    ("12 décembre 2025 à 6h47", "de", "2025-12-12T05:47:00Z"), ("Apr 25, 2026 8:16PM", "ny", "2026-04-26T00:16:00Z"), ("Apr 25, 2026 12:00 AM", "a", "2026-04-25T00:00:00Z"),
    ("2025年9月1日 18時58分", "a", "2025-09-01T18:58:00Z"), ("2 weeks ago", "ny", "2026-03-06T12:00:00Z"), ("10分前", "ny", "2026-03-20T11:50:00Z"),
    # clock changes: skipped hour by the offset before, repeated hour by its first occurrence
    ("2026-03-08T02:30", "ny", "2026-03-08T07:30:00Z"), ("2025-11-02T01:30", "ny", "2025-11-02T05:30:00Z"), ("2025-10-26T02:30", "de", "2025-10-26T00:30:00Z"),
    ("2026-03-01T10:00", "unknown", "2026-03-01T10:00:00Z"), ("2026-03-01T10:00", None, "2026-03-01T10:00:00Z"),
    *[(x, "ny", None) for x in (None, "", "  ", "soon", "2026-02-30", "2026-13-05T09:00:00Z", "0000-00-00", "Q3", "25:00", "x" * 100_000)],
]
SOURCES = [("a", "UTC", "en-GB"), ("ny", "America/New_York", "en-US"), ("gb", "Europe/London", "en-GB"), ("de", "Europe/Berlin", "de-DE"), ("bad", "Mars/Base", "en-GB")]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "id string, feed_tz string, feed_locale string").selectExpr("*", "'clash' as published", "1L as candidate_id")


def run(spark, sources, rows):
    df = spark.createDataFrame(rows, "candidate_id long, published string, source_id string, fetched_at timestamp, _seq int, feed_tz string")
    out = TS.normalise_times(df, sources, "candidate_id", "published", "source_id", "fetched_at")
    return {r.candidate_id: r.u for r in out.select("candidate_id", TS.utc_text(out.at).alias("u")).collect()}


def test_notations_nulls_and_clashing_columns(spark, sources):
    rows = [(i, v, s, AT, 7, "x") for i, (v, s, _) in enumerate(CASES)] + [(None, "20260105", "a", AT, 7, "x"), (900, "2 days ago", "a", None, 7, "x")]
    got = run(spark, sources, rows + rows[:5])
    assert got == {i: w for i, (_, _, w) in enumerate(CASES) if w is not None}


def test_empty_table(spark, sources):
    assert run(spark, sources, []) == {}


@pytest.mark.parametrize("block,backfill", [(2000, False), (1, False), (3, True)])
def test_unknown_locale_follows_its_source_and_equals_one_pass(spark, sources, monkeypatch, block, backfill):
    monkeypatch.setattr(TS, "BLOCK_ROWS", block)
    rnd = random.Random(3)
    day = dt.datetime(2026, 1, 1)
    rows, key = [], 0
    for d in range(60):
        for k in range(rnd.randrange(4)):
            t = day + dt.timedelta(days=d, hours=k)
            text = t.strftime("%d/%m/%Y %H:%M") if rnd.random() < 0.8 else t.strftime("%Y-%m-%dT%H:%M")
            rows.append((key, text, "nowhere", None if backfill else t + dt.timedelta(hours=1), 0, "x"))
            key += 1
    got = run(spark, sources, rows)
    # the same chain in one piece
    states = []
    for _, text, *_ in rows:
        c = []
        for fmt, name in (("%Y-%m-%dT%H:%M", "iso"), ("%m/%d/%Y %H:%M", "mdy"), ("%d/%m/%Y %H:%M", "dmy")):
            try:
                at = dt.datetime.strptime(text, fmt).replace(tzinfo=dt.timezone.utc).timestamp()
            except ValueError:
                continue
            if at not in [x[1] for x in c]:
                c.append((name, at))
        states.append((np.array([x[0] for x in c], object), np.array([x[1] for x in c]), np.zeros(len(c))))
    path, total = TS.viterbi(states)

    def cost(pick):
        s = [(st[0][i : i + 1], st[1][i : i + 1], st[2][i : i + 1]) for st, i in zip(states, pick)]
        return TS.viterbi(s)[1]

    mine = []
    for k, st in enumerate(states):
        at = dt.datetime.strptime(got[k], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=dt.timezone.utc).timestamp()
        mine.append(int(np.flatnonzero(st[1] == at)[0]))
    assert cost(mine) == pytest.approx(total) == cost(path)
    right = len(rows) if backfill else sum(got[k] == (rows[k][3] - dt.timedelta(hours=1)).strftime("%Y-%m-%dT%H:%M:%SZ") for k in got)
    assert right >= 0.9 * len(rows)
