"""Mixed timestamp notations to one UTC time.

Every value gets an array of all its valid interpretations (notation, instant, cost). Where there is more than one, a
Viterbi pass over the record order of the value's source chooses: a change of notation and a step back in time cost
extra. A source's declared locale outweighs any such cost, as the data's definition demands.

Scale: parsing stays in the JVM and needs no shuffle. Records are cut into blocks of one source and one UTC day, and days of
many records on into blocks of about BLOCK_ROWS, so no task holds a source or a backfilled day. Blocks with a choice to
make are reduced to a min-plus matrix between the interpretations of their first and last record, blocks without one to
their two end states. A record with one interpretation parts what comes before from what comes after, so the matrices are
chained run by run, between blocks without a choice, and each block is then solved between its chosen ends. This equals the
Viterbi pass over the whole source.
"""

from __future__ import annotations

import zoneinfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import small_side, stored

# Month names of the feeds' languages, by their first letters.
MONTHS = {
    1: ("jan", "janvier", "januar", "enero", "january"),
    2: ("feb", "février", "fevrier", "februar", "febrero", "february"),
    3: ("mar", "mars", "märz", "marz", "marzo", "march"),
    4: ("apr", "avril", "april", "abril"),
    5: ("may", "mai", "mayo"),
    6: ("jun", "juin", "juni", "junio", "june"),
    7: ("jul", "juillet", "juli", "julio", "july"),
    8: ("aug", "août", "aout", "august", "agosto"),
    9: ("sep", "sept", "septembre", "september", "septiembre"),
    10: ("oct", "octobre", "oktober", "okt", "octubre", "october"),
    11: ("nov", "novembre", "november", "noviembre"),
    12: ("dec", "décembre", "decembre", "dezember", "dez", "diciembre", "december"),
}
# Zone abbreviations, minutes east of UTC.
ZONES = {
    "z": 0, "gmt": 0, "utc": 0, "ut": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "msk": 180, "jst": 540, "kst": 540, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180, "brt": -180, "art": -180,
    "ist": 330, "sgt": 480, "hkt": 480, "pht": 480, "awst": 480, "acst": 570, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}
# Seconds of the units of relative times.
UNITS = {
    "second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "day": 86400, "week": 604800,
    "秒": 1, "分": 60, "時間": 3600, "日": 86400, "週間": 604800,
}

#: Records of a block, beyond which a day is cut on.
BLOCK_ROWS = 2000
SWITCH_COST, BACK_COST_A_DAY, BACK_COST_MOST, LOCALE_COST = 1.0, 0.05, 2.0, 100.0

def _lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


# The notations, as patterns over the lower-cased value without its zone and fraction.
NOTATIONS = {
    "iso": r"^\d{4}-\d{2}-\d{2}(?:[t ]\d{2}:\d{2}(?::\d{2})?)?$",
    "basic": r"^\d{8}(?:t\d{4}(?:\d{2})?)?$",
    "epoch_s": r"^\d{10}$",
    "epoch_ms": r"^\d{13}$",
    "ymd": r"^\d{4}[/.]\d{1,2}[/.]\d{1,2}(?: \d{1,2}:\d{2}(?::\d{2})?)?$",
    "slash": r"^\d{1,2}/\d{1,2}/\d{4}(?:,? \d{1,2}:\d{2}(?::\d{2})?)?$",
    "dots": r"^\d{1,2}\.\d{1,2}\.\d{4}(?:,? \d{1,2}:\d{2}(?::\d{2})?(?: uhr)?)?$",
    "day_month": r"^(?:\p{L}+\.?,? )?\d{1,2}\.? \p{L}{3,}\.?,? \d{4}(?:,?(?: à| um| at| a las)? \d{1,2}[:h]\d{2}(?::\d{2})?(?: uhr)?)?$",
    "month_day": r"^(?:\p{L}+\.?,? )?\p{L}{3,}\.? \d{1,2},? \d{4}(?:,?(?: at)? \d{1,2}:\d{2}(?::\d{2})?\s?(?:am|pm|a\.m\.|p\.m\.)?)?$",
    "cjk": r"^\d{4}年\d{1,2}月\d{1,2}日(?: ?\d{1,2}[時点:]\d{2}[分:]?(?:\d{2}秒?)?)?$",
    "ago": r"^\d{1,6} ?(?:second|sec|minute|min|hour|hr|day|week)s? ago$",
    "ago_ja": r"^\d{1,6} ?(?:秒|分|時間|日|週間)前$",
}
_ZONE = r"\s?(z|[+-]\d{2}:?\d{2}|(?:utc|gmt)[+-]\d{1,2}|[a-z]{2,4})$"
_NOT_ZONE = r"(?:am|pm|uhr|ago)$"


def with_readings(rows: DataFrame, value: str, fetched_at: str, tz: str, locale: str) -> DataFrame:
    """rows with _readings: array<struct<fmt, at, cost>>, all valid readings of value; at in seconds since 1970 UTC.

    Null, empty and wordy values and impossible dates have none. An unknown zone is UTC; an unknown locale leaves both
    readings of a slash date at equal cost. Each step is a projection of its own, so no pattern is run twice on a row.
    """
    kept = rows.columns
    low = F.lower(F.trim(F.regexp_replace(F.col(value), r"[\s\u00a0\u2009\u202f\u3000]+", " ")))
    r = rows.withColumn("_low", low)
    timed = F.col("_low").rlike(r"\d(?::\d{2}|t\d{4})") & ~F.col("_low").rlike(_NOT_ZONE)
    r = r.withColumn("_zone", F.when(timed, F.regexp_extract("_low", r"(?:\d|\s)" + _ZONE, 1)).otherwise(""))
    body = F.when(F.col("_zone") != "", F.expr("rtrim(substring(_low, 1, length(_low) - length(_zone)))")).otherwise(F.col("_low"))
    r = r.withColumn("_body", F.regexp_replace(body, r"(:\d{2})[.,]\d+$", "$1"))
    fmt = None
    for name, pattern in NOTATIONS.items():
        test = F.col("_body").rlike(pattern)
        fmt = F.when(test, name) if fmt is None else fmt.when(test, name)
    r = r.withColumn("_fmt", F.coalesce(fmt, F.lit("none")))
    spaced = F.when(
        F.col("_fmt") == "basic", F.regexp_replace("_body", r"^(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(\d{2})?)?$", "$1 $2 $3 $4 $5 $6")
    ).otherwise(F.col("_body"))
    r = r.withColumn("_n", F.transform(F.regexp_extract_all(spaced, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint")))
    names = {n: m for m, ns in MONTHS.items() for n in ns}
    is_mon = F.col("_fmt").isin("day_month", "month_day")
    word = F.when(F.col("_fmt") == "day_month", F.regexp_extract("_body", r"\d\.? (\p{L}{3,})", 1)).when(
        F.col("_fmt") == "month_day", F.regexp_extract("_body", r"(\p{L}{3,})\.? \d", 1)
    )
    r = r.withColumn("_month", F.when(is_mon, _lookup(names, word)))

    n = lambda i: F.get(F.col("_n"), F.lit(i)).cast("int")
    f = F.col("_fmt")
    first = f.isin("iso", "basic", "ymd", "cjk")
    y = F.when(first, n(0)).when(is_mon, n(1)).otherwise(n(2))
    mo = F.when(first, n(1)).when(is_mon, F.col("_month")).when(f == "slash", n(0)).otherwise(n(1))
    d = F.when(first, n(2)).when(is_mon | (f == "dots"), n(0)).otherwise(n(1))
    k = F.when(is_mon, 2).otherwise(3)
    at = lambda i: F.get(F.col("_n"), k + i).cast("int")
    half = F.when(f == "month_day", F.regexp_extract("_body", r"(a|p)\.?m\.?$", 1)).otherwise("")
    h0 = F.coalesce(at(0), F.lit(0))
    h = F.when(half == "", h0).when(h0.between(1, 12), F.pmod(h0, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    calendar = ~f.isin("epoch_s", "epoch_ms", "ago", "ago_ja", "none")
    r = r.withColumns({"_y": F.when(calendar, y), "_mo": mo, "_d": d, "_h": h, "_mi": F.coalesce(at(1), F.lit(0)), "_s": F.coalesce(at(2), F.lit(0))})
    stamp = lambda m, dd: F.when(
        (F.col("_y") >= 1), F.try_make_timestamp(F.col("_y"), m, dd, F.col("_h"), F.col("_mi"), F.col("_s").cast("decimal(8,6)"))
    )
    ok_time = F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
    r = r.withColumns({
        "_w1": F.when(ok_time, stamp(F.col("_mo"), F.col("_d"))),
        "_w2": F.when(ok_time & (f == "slash") & (F.col("_mo") != F.col("_d")), stamp(F.col("_d"), F.col("_mo"))),
    })
    z = F.col("_zone")
    sign = F.when(z.rlike("-"), -1).otherwise(1)
    digits = F.regexp_replace(z, "[^0-9]", "")
    hh, mm = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    east = F.when(z.rlike("[0-9]"), F.when((hh <= 14) & (mm <= 59), sign * (hh * 60 + mm))).otherwise(_lookup(ZONES, z))
    here = F.when(F.col(tz).isin(sorted(zoneinfo.available_timezones())), F.col(tz)).otherwise(F.lit("UTC"))
    r = r.withColumns({"_east": F.when(z != "", east), "_here": here})
    utc = lambda w: F.when(z == "", F.unix_seconds(F.to_utc_timestamp(w, F.col("_here")))).otherwise(F.unix_seconds(w) - F.col("_east") * 60)
    num = F.get(F.col("_n"), F.lit(0))
    unit = F.when(f == "ago", F.regexp_extract("_body", r"(second|sec|minute|min|hour|hr|day|week)s? ago$", 1)).otherwise(
        F.regexp_extract("_body", "(秒|分|時間|日|週間)前$", 1)
    )
    single = F.when(f == "epoch_s", num).when(f == "epoch_ms", F.floor(num / 1000)).when(
        f.isin("ago", "ago_ja"), F.unix_seconds(fetched_at) - num * _lookup(UNITS, unit)
    ).otherwise(utc(F.col("_w1")))
    free, loc = F.lit(0.0), F.col(locale)
    unknown, us = loc.isNull() | (loc == ""), loc == "en-US"
    cost = lambda mine: F.when((f != "slash") | unknown | mine, free).otherwise(F.lit(LOCALE_COST))
    reading = lambda name, t, c: F.struct(name.alias("fmt"), t.cast("long").alias("at"), c.alias("cost"))
    both = F.array(
        reading(F.when(f == "slash", F.lit("mdy")).otherwise(f), single, cost(us)), reading(F.lit("dmy"), utc(F.col("_w2")), cost(~us))
    )
    return r.withColumn("_readings", F.filter(both, lambda x: x["at"].isNotNull())).select(*kept, "_readings")


States = tuple[list, list, list]  # notations, instants and costs of one record's readings


def _move(fmt_a: str, at_a: float, fmt_b: str, at_b: float) -> float:
    back = (at_a - at_b) / 86400 * BACK_COST_A_DAY
    return (SWITCH_COST if fmt_a != fmt_b else 0.0) + (0.0 if back <= 0 else min(back, BACK_COST_MOST))


def _advance(cost: list[float], a: States, b: States) -> tuple[list[float], list[int]]:
    """The cheapest costs of reaching each reading of b from readings of a that cost so much, and from which; ties go to the earlier."""
    out, came = [], []
    for fb, tb, cb in zip(*b):
        steps = [c + _move(fa, ta, fb, tb) for c, fa, ta in zip(cost, a[0], a[1])]
        k = steps.index(min(steps))
        out.append(steps[k] + cb)
        came.append(k)
    return out, came


def viterbi(states: list[States], first: int | None = None, last: int | None = None) -> tuple[list[int], float]:
    """The cheapest path over the readings of consecutive records, with the ends fixed where given; ties go to the earlier reading."""
    cost = [c if first is None or k == first else float("inf") for k, c in enumerate(states[0][2])]
    back = []
    for a, b in zip(states, states[1:]):
        cost, came = _advance(cost, a, b)
        back.append(came)
    end = cost.index(min(cost)) if last is None else last
    total, path = float(cost[end]), [end]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1], total


def _flat(readings: str, prefix: str) -> list[Column]:
    """The readings as three parallel arrays: structs in arrays are slow to bring into Python."""
    return [F.col(f"{readings}.{x}").alias(f"{prefix}_{x}") for x in ("fmt", "at", "cost")]


def _states(pdf: pd.DataFrame, prefix: str) -> list[States]:
    return [(list(f), list(t), list(c)) for f, t, c in zip(pdf[f"{prefix}_fmt"], pdf[f"{prefix}_at"], pdf[f"{prefix}_cost"])]


def _block_matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    """The least cost between each reading of a block's first record and each of its last, row by row: a min-plus product."""
    pdf = pdf.sort_values(["_seq", "_key"])
    states = _states(pdf, "_r")
    matrix = []
    for i in range(len(states[0][0])):
        cost = [c if k == i else float("inf") for k, c in enumerate(states[0][2])]
        for a, b in zip(states, states[1:]):
            cost, _ = _advance(cost, a, b)
        matrix += cost
    return pd.DataFrame({"_src": [pdf["_src"].iloc[0]], "_block": [pdf["_block"].iloc[0]], "_matrix": [matrix]})


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Over a run of a source's blocks: the states in which the cheapest path enters and leaves each block.

    Between two blocks of single readings there is nothing to choose, so only open blocks and their neighbours cost work.
    """
    pdf = pdf.sort_values("_block")
    cost, prev, prev_one, steps = None, None, True, []
    for fs, ls, m, is_open in zip(_states(pdf, "_first"), _states(pdf, "_last"), pdf["_matrix"], pdf["_open"]):
        if not is_open and prev_one:
            steps.append(([0], [0]))
            cost, prev = None, ls
            continue
        free = (fs[0], fs[1], [0.0] * len(fs[0]))
        if prev is None:
            enter, came = free[2], [0] * len(fs[0])
        else:
            enter, came = _advance(cost if cost is not None else [0.0] * len(prev[0]), prev, free)
        if not is_open:
            steps.append((came, [0]))
            cost, prev, prev_one = None, ls, True
            continue
        width = len(m) // len(enter)
        best, arg = [], []
        for j in range(width):
            col = [e + m[i * width + j] for i, e in enumerate(enter)]
            k = col.index(min(col))
            best.append(col[k])
            arg.append(k)
        steps.append((came, arg))
        cost, prev, prev_one = best, ls, False
    out, end = [], cost.index(min(cost)) if cost is not None else 0
    for came, arg in reversed(steps):
        begin = arg[end]
        out.append((begin, end))
        end = came[begin]
    out.reverse()
    return pd.DataFrame({"_src": pdf["_src"].values, "_block": pdf["_block"].values, "_begin": [x[0] for x in out], "_end": [x[1] for x in out], "_open": pdf["_open"].values})


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_seq", "_key"])
    states = _states(pdf, "_r")
    path, _ = viterbi(states, int(pdf["_begin"].iloc[0]), int(pdf["_end"].iloc[0]))
    ok = [(k, int(s[1][p]), s[0][p]) for k, n, s, p in zip(pdf["_key"], pdf["_n"], states, path) if n > 1]
    return pd.DataFrame({"_key": [x[0] for x in ok], "_at": [x[1] for x in ok], "_fmt": [x[2] for x in ok]}).astype({"_key": "int64", "_at": "int64"})


def _blocked(r: DataFrame) -> DataFrame:
    """r with _block: a source's records in order, cut by day and days of more than BLOCK_ROWS records cut on, by time or, where all have one time, by key."""
    day = F.coalesce(F.to_date("_seq"), F.lit("1970-01-01").cast("date"))
    at = F.coalesce(F.unix_micros("_seq"), F.lit(0))
    r = r.withColumns({"_day": F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long"), "_us": at})
    d = r.groupBy("_src", "_day").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.min("_key").alias("_klo"), F.max("_key").alias("_khi")
    )
    d = d.filter(F.col("_rows") > BLOCK_ROWS)
    r = r.join(small_side(stored(d, "days")), ["_src", "_day"], "left")
    timed = F.col("_hi") > F.col("_lo")
    v, lo, hi = F.when(timed, F.col("_us")).otherwise(F.col("_key")), F.when(timed, F.col("_lo")).otherwise(F.col("_klo")), F.when(timed, F.col("_hi")).otherwise(F.col("_khi"))
    part = F.floor((v - lo).cast("double") / (hi - lo + 1).cast("double") * F.ceil(F.col("_rows") / BLOCK_ROWS))
    block = F.col("_day") * F.lit(1 << 20) + F.least(F.coalesce(part, F.lit(0)), F.lit((1 << 20) - 1))
    return r.withColumn("_block", block.cast("long")).drop("_day", "_us", "_rows", "_lo", "_hi", "_klo", "_khi")


def normalise_times(rows: DataFrame, sources: DataFrame, key: str, value: str, source: str, fetched: str) -> DataFrame:
    """(key, at, fmt): one row per key whose value has a valid reading; at in seconds since 1970 UTC.

    key: a bigint column; repeated rows of a key are taken once. sources: id, feed_tz, feed_locale; a source id that
    occurs in it more than once gives its smallest zone and locale. Rows of unknown or null source form one source
    without zone and locale. Other columns of either table, whatever their names, are not read.
    """
    dim = sources.groupBy(F.col("id").alias("_sid")).agg(F.min("feed_tz").alias("_tz"), F.min("feed_locale").alias("_loc"))
    r = rows.select(
        F.col(key).cast("long").alias("_key"), F.col(value).alias("_value"), F.col(source).alias("_sid"), F.col(fetched).alias("_fetched")
    ).filter((F.trim("_value") != "") & F.col("_key").isNotNull())
    r = with_readings(r.join(small_side(dim), "_sid", "left"), "_value", "_fetched", "_tz", "_loc")
    r = r.select("_key", F.coalesce("_sid", F.lit("")).alias("_src"), F.col("_fetched").alias("_seq"), "_readings")
    # written first: a filter over the readings would be pushed down and inline all of the parsing several times
    r = stored(r, "readings").filter(F.size("_readings") > 0).withColumn("_n", F.size("_readings"))
    r = _blocked(r)
    one = r.filter(F.col("_n") == 1).select("_key", F.col("_readings")[0]["at"].alias("_at"), F.col("_readings")[0]["fmt"].alias("_fmt"))

    order = F.struct("_seq", "_key")
    blocks = r.groupBy("_src", "_block").agg(
        F.min_by("_readings", order).alias("_first"), F.max_by("_readings", order).alias("_last"), F.max(F.col("_n") > 1).alias("_open")
    )
    open_blocks = blocks.filter("_open").select("_src", "_block")
    inside = r.join(open_blocks, ["_src", "_block"]).dropDuplicates(["_key"])
    cols = inside.select("_src", "_block", "_seq", "_key", "_n", *_flat("_readings", "_r"))
    # spread by number: by size alone these few bytes of much work would be put into one task
    spread = 2 * rows.sparkSession.sparkContext.defaultParallelism
    matrices = cols.repartition(spread, "_src", "_block").groupBy("_src", "_block").applyInPandas(_block_matrix, "_src string, _block long, _matrix array<double>")
    # a block of single readings fixes the path, so a chain is a run of open blocks between two such, which it shares with its neighbours
    along = Window.partitionBy("_src").orderBy("_block")
    runs = blocks.withColumns({
        "_run": F.count_if(~F.col("_open")).over(along.rowsBetween(Window.unboundedPreceding, 0)),
        "_before": F.lag("_open", 1, False).over(along), "_after": F.lead("_open", 1, False).over(along),
    })
    runs = stored(runs.filter("_open or _before or _after"), "runs")
    runs = runs.filter("_open or _after").unionByName(runs.filter("not _open and _before").withColumn("_run", F.col("_run") - 1)).drop("_before", "_after")
    chained = (
        runs.join(matrices, ["_src", "_block"], "left")
        .select("_src", "_run", "_block", "_open", "_matrix", *_flat("_first", "_first"), *_flat("_last", "_last"))
        .repartition(spread, "_src", "_run")
        .groupBy("_src", "_run")
        .applyInPandas(_chain, "_src string, _block long, _begin int, _end int, _open boolean")
        .filter("_open")
        .drop("_open")
    )
    # written: after the join's own shuffle on these columns the planner would drop the repartition and put all into one task
    ends = stored(cols.join(chained, ["_src", "_block"]), "ends")
    many = (
        ends.repartition(spread, "_src", "_block")
        .groupBy("_src", "_block")
        .applyInPandas(_solve, "_key long, _at long, _fmt string")
    )
    return (
        one.unionByName(many)
        .groupBy("_key")
        .agg(F.min(F.struct("_at", "_fmt")).alias("_x"))
        .select(F.col("_key").alias(key), F.col("_x._at").alias("at"), F.col("_x._fmt").alias("fmt"))
    )


def utc_text(at: Column) -> Column:
    return F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")
