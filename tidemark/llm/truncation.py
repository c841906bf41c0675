"""Text cut off by field limits: at which lengths a source's texts pile up, and how each text ends.

Two rules, kept apart. limit: per source the lengths of all texts, in characters and in UTF-8 bytes, are counted; a length
that occurs far more often than its neighbours is a field limit, the greatest length that a cut text has there, and every
prose text at it without terminal punctuation is cut, whatever its end looks like otherwise. ending: a text may also be cut
in transfer, at any length, which no histogram can show; so a prose text elsewhere is cut if it ends in a broken character,
tag or entity, in dots added at the break, or in a last line that stops inside a sentence and is none of the ends that
complete texts have without a full stop.

The histograms are pre-aggregated per (source, length), so a hot source is as many rows as it has lengths; texts pass
through Python once, in whole, and are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import small_side, stored

#: A length is a spike if it occurs at least LEAST times, RATIO times as often as its neighbours within NEAR on average, and SIGMA deviations more.
NEAR, LEAST, RATIO, SIGMA = 60, 5, 4.0, 6.0

_DOTS = re.compile(r"(?:\.{2,}|…|(?:\[|\()\s*(?:\.{2,}|…)\s*(?:\]|\)))\s*$")
_TERMINAL = re.compile(r"[.!?。！？｡‽؟।](?:[\"”’»'）)」』\]]|&quot;)*\s*$")
_BROKEN = re.compile(r"(?:&#?[A-Za-z0-9]{0,8}|<[A-Za-z/!][^<>]*|<|�+|[\ud800-\udfff])\s*$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_KANA = re.compile(r"[぀-ゟ]")
_WORD = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"^\s*(?:[-–—*•・‣▪○●]|\d{1,2}[.)])\s+\S")
_LINK = re.compile(r"(?:https?://|www\.)\S+\s*$", re.I)
_MAIL = re.compile(r"\S+@\S+\.\w+\s*$")
_CONTACT = re.compile(r"^\s*(?:source|sources|quelle|fuente|contact|kontakt|contacto|press|tel|telephone|phone|telefon|tél|fax|e-?mail|web|website|url|お問い合わせ|出典|連絡先)\b\.?\s*[:.]?\s*\S", re.I)
_PHONE = re.compile(r"\+?\d[\d\s()/-]{5,}\s*$")
_TAGS = re.compile(r"(?:^|\s)#\w[\w-]*(?:\s+#\w[\w-]*)*\s*$")
_TAGLINE = re.compile(r"^\s*(?:tags?|keywords?|topics?|filed under|schlagworte|mots-clés|etiquetas)\s*:", re.I)
_COPY = re.compile(r"^\s*(?:©|\(c\)|copyright)\s", re.I)
_END = re.compile(r"^\s*(?:[-–—*#~=_+■◆]{1,}\s*(?:ends?|ende|fin|fine|end of \w+|\d{1,3}|以上|了)?\s*[-–—*#~=_+■◆]*|ends?|ende|fin|以上|\[ends?\]|\(ends?\)|\(以上\)|\(了\)|\d{1,2}/\d{1,2})\s*$", re.I)
_PLACE_DATE = re.compile(r"^\s*\(?[^\W\d_][^,()]{1,30},?\s+(?:\d{1,2}[./]\s?\d{1,2}[./]\s?\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}\.?\s+\w+\s+\d{4}|\w+\s+\d{1,2},?\s+\d{4})\)?\s*$")
_DATE_JA = re.compile(r"^\s*[（(]?\S{0,8}?、?\d{4}年\d{1,2}月\d{1,2}日[）)]?\s*$")


def prose(text: str) -> bool:
    """Whether a text is running language: not a table, code, sequence, record, symbols or character sample."""
    s = text.strip()
    if len(s) < 12 or s[0] in "{[" and re.search(r"[\"\]}:,]", s[:40]) and s.count('"') >= 4:
        return False
    letters = sum(c.isalpha() for c in s)
    if letters < 0.55 * sum(not c.isspace() for c in s):
        return False
    if s.count("\t") * 60 > len(s) and letters < 0.75 * sum(not c.isspace() for c in s):
        return False
    if _KANA.search(s):
        return len(_CJK.findall(s)) >= 8
    words = _WORD.findall(s)
    if len(words) < 4:
        return False
    if max(map(len, words)) > 60:
        return False
    small = sum(w[0].islower() for w in words)
    return small >= 0.25 * len(words)


def _signature(last: str, before: str) -> bool:
    """A person's name on a line of its own with a role below it, or a name and role on one line."""
    words = last.split()
    name = before.split()
    is_name = 1 < len(name) <= 4 and all(w[0].isupper() for w in name if w[0].isalpha()) and not before.rstrip().endswith((".", ":", "。"))
    return 0 < len(words) <= 6 and len(last) <= 60 and is_name


def ending(text: str) -> str:
    """How a prose text ends: sentence, dots, broken, or open (inside a sentence); else the kind of unpunctuated complete end."""
    if _DOTS.search(text):
        return "dots"
    if _BROKEN.search(text) and not _LINK.search(text.splitlines()[-1] if text.strip() else text):
        return "broken"
    s = text.rstrip()
    lines = [x for x in s.splitlines() if x.strip()]
    last = lines[-1]
    before = lines[-2] if len(lines) > 1 else ""
    if len(lines) > 1 or len(last) < 90:
        if _END.match(last):
            return "mark"
        if _COPY.match(last):
            return "copyright"
        if _CONTACT.match(last) and len(last) <= 160:
            return "contact"
        if _PLACE_DATE.match(last) or _DATE_JA.match(last):
            return "place"
        if _TAGLINE.match(last):
            return "tags"
    if _TAGS.search(last) and len(lines) > 1:
        return "tags"
    if _TERMINAL.search(s):
        return "sentence"
    if _LINK.search(last) or _MAIL.search(last):
        return "contact"
    if s[-1] in "\"”»」" and any(q in last[:-1] for q in "\"“«「"):
        return "quote"
    if _PHONE.search(last) and len(last) <= 40 and len(lines) > 1:
        return "contact"
    if len(lines) > 1 and _signature(last, before):
        return "signature"
    if _BULLET.match(last) and (_BULLET.match(before) or before.rstrip().endswith(":") or before.rstrip().endswith("：")):
        return "list"
    return "open"


CUT_ENDS = ("dots", "broken", "open")


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ends, stops = [], []
        for t in b["text"]:
            some = t is not None and t.strip() != "" and prose(t)
            ends.append(ending(t) if some else "none")
            stops.append(some and bool(_TERMINAL.search(t)) and not _DOTS.search(t))
        yield pd.DataFrame(
            {"key": b["key"], "source": b["source"], "ends": ends, "stop": stops, "chars": [None if t is None else len(t) for t in b["text"]], "bytes": [None if t is None else len(t.encode("utf-8", "replace")) for t in b["text"]]}
        )


def judged(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, ends, stop, chars, bytes) of each row; stop: terminal punctuation; ends is none for null, empty, blank and non-prose texts."""
    kind = dict(rows.dtypes)[key]
    r = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    return r.mapInPandas(_judge, f"key {kind}, source string, ends string, stop boolean, chars long, bytes long")


def spikes(lengths: DataFrame) -> DataFrame:
    """(source, unit, length, n, around): lengths at which a source's texts pile up, of (source, chars, bytes)."""
    both = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    h = lengths.select("source", both.alias("x")).select("source", "x.unit", "x.length").filter("length > 0").groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-NEAR, NEAR)
    h = h.withColumn("around", (F.sum("n").over(w) - F.col("n")) / (2 * NEAR))
    return h.filter((F.col("n") >= LEAST) & (F.col("n") >= RATIO * F.col("around")) & (F.col("n") >= F.col("around") + SIGMA * F.sqrt(F.greatest("around", F.lit(0.25)))))


def truncated(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, ends, at_limit, rule, cut): every row, with whether its length is a limit of its source, the rule by which it is cut, and whether it is.

    rule: limit (prose at a limit without terminal punctuation), else ending (ends with dots, broken or open), else null.
    Null, empty, blank and non-prose texts are never cut. A null source is one source. Rows of equal key are judged
    alike; an empty table gives no rows, rows without a key are left out.
    """
    j = stored(judged(rows, key, text, source), "judged")
    s = stored(spikes(j.filter("ends <> 'none'")).select(F.coalesce("source", F.lit("")).alias("_s"), "unit", "length"), "spikes")
    limit_c = small_side(s.filter("unit = 'chars'").select("_s", F.col("length").alias("chars"), F.lit(True).alias("_c")))
    limit_b = small_side(s.filter("unit = 'bytes'").select("_s", F.col("length").alias("bytes"), F.lit(True).alias("_b")))
    j = j.withColumn("_s", F.coalesce("source", F.lit(""))).join(limit_c, ["_s", "chars"], "left").join(limit_b, ["_s", "bytes"], "left")
    at = F.coalesce(F.col("_c") | F.col("_b"), F.col("_c"), F.col("_b"), F.lit(False))
    prose_ = F.col("ends") != "none"
    rule = F.when(prose_ & at & ~F.col("stop"), "limit").when(F.col("ends").isin(*CUT_ENDS), "ending")
    return j.select(F.col("key").alias(key), "source", "ends", at.alias("at_limit"), rule.alias("rule"), rule.isNotNull().alias("cut"))
