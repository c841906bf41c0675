"""New batches against everything accepted: an index on disk, look-ups that follow the batch, append.

A headline's fingerprint has BLOCKS blocks of bits. A block is the hash of one word of the headline, drawn by a weighted
minimum (rare words weigh more), so headlines that share much of their weight agree in many blocks and differ by random
bits in the others. If the drawn word is in more than WIDE headlines, the block is the hash of that and the next draws, as
many as bring its expected number of headlines below: such a block counts as that many. The index holds the fingerprints in BLOCKS block tables, table k with the fingerprint rotated so that
its block k leads: the table's number and that block are the key. A batch looks up the exact blocks of its own headlines;
each table in which two headlines meet is a block without a bit of difference, so the number of blocks that differ - the
Hamming distance over blocks - is counted from the hits. Pairs within RADIUS go to the comparison of their texts, then the
batch is appended. Matched headlines look up in turn until nothing new is found, so that an item's first record is
reached through any chain.

Nodes of that search are distinct headlines and pages, not rows: copies of one headline or page are one key, pre-aggregated
with their least id, however many they are. Block and headline tables are bucketed by their key, so a look-up shuffles the
batch's keys but never the index; few keys read only their own buckets. Everything lies in one folder: a part per append,
a log that names the complete parts, and the word weights of the first part; open() takes it up in another session.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import sketch as S
from tidemark.llm.pages import page_key_column
from tidemark.llm.text import NOT_WORD, consistent, suspect
from tidemark.operators.components import components
from tidemark.session import drop_stored, shared_dir, small_side, stored, stored_bytes

BLOCKS = 24
#: Blocks that may differ: at least two of all must be equal.
RADIUS = BLOCKS - 2
#: Words no more frequent than this weigh alike, so that a typing slip does not outweigh a name.
RARE = 4
#: Headlines expected to share a block at most, unless it holds DRAWS words; of the headlines with its rarest word, each further
#: word is taken to leave one in SPREAD.
WIDE, DRAWS, SPREAD = 256, 4, 2
#: A word written in lower case at least so often is an ordinary one.
ORDINARY = 3
#: Rows of a block table a bucket, and the number of keys up to which only their buckets are read.
BUCKET_ROWS, FEW_KEYS = 4_000_000, 1000
#: Size of a written table above which its keys aren't counted.
FEW_BYTES = 64 << 10

# Labels set before a headline.
LABEL_WORDS = ("news", "exclusive", "update", "updated", "breaking", "corrected", "correction", "live", "alert")
LABELS = r"^\s*(?:\[[\p{L} ]{3,20}\]|(?:" + "|".join(LABEL_WORDS) + r")\s*(?::|\s[-–]\s))\s*"
#: A publisher's name after a separator at the end: up to three words, or a clipped one.
PUBLISHER = r"\s+[-|–—]\s+(?:[\p{L}\p{N}.&'’]+\s?){1,3}(?:\.{3}|…)?\s*$"

#: The same turned round to the front.
TURNED = r"^\s*[|–—-]\s+\p{Lu}\S*\s+\p{Lu}\S*\s+(?=\p{Lu})"


@F.pandas_udf(T.StringType())
def _cased(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else consistent(x))


def headline(title: Column) -> Column:
    """The headline itself: characters made consistent, labels and publisher cut off, codes written together; case kept."""
    c = F.coalesce(_cased(F.when(suspect(title), title)), title)
    c = F.regexp_replace(c, "(?i)" + LABELS, "")
    parted = c.contains("- ") | c.contains("| ") | (F.octet_length(c) > F.char_length(c))
    c = F.when(parted, F.regexp_replace(F.regexp_replace(c, PUBLISHER, ""), TURNED, "")).otherwise(c)
    joined = F.regexp_replace(c, r"(?<=\b[A-Za-z]{1,6})[-‐](?=\d)", "")
    return F.trim(F.when(c.contains("-") | c.contains("‐"), joined).otherwise(c))


def _words(c: Column) -> Column:
    """Words of a headline; runs of katakana, kanji and hiragana are words of their own."""
    spaced = F.regexp_replace(c, r"([\p{IsKatakana}ー]+|\p{IsHan}+|\p{IsHiragana}+)", " $1 ")
    return F.filter(F.split(F.when(F.octet_length(c) > F.char_length(c), spaced).otherwise(c), NOT_WORD), lambda w: w != "")


def prepared(rows: DataFrame, key: str, title: str, url: str) -> DataFrame:
    """(id, h, head, w, low, p): hash of the headline, the headline, hashes of its words in lower case, those of words that begin in lower case, page hash.

    h and p are null for a headline without words and for no page.
    """
    head = headline(F.col(title))
    r = rows.select(F.col(key).cast("long").alias("id"), head.alias("head"), page_key_column(F.col(url)).alias("page"))
    r = r.filter("id is not null").withColumn("words", F.coalesce(_words(F.col("head")), F.array().cast("array<string>")))
    first = lambda w: F.substring(w, 1, 1)
    small = F.filter("words", lambda w: (first(w) == F.lower(first(w))) & (first(w) != F.upper(first(w))))
    return r.select(
        "id",
        F.when(F.size("words") > 0, F.xxhash64("head")).alias("h"),
        "head",
        F.transform("words", lambda w: F.xxhash64(F.lower(w))).alias("w"),
        F.transform(small, lambda w: F.xxhash64(w)).alias("low"),
        F.when(F.col("page").isNotNull(), F.xxhash64(F.lit("page"), "page")).alias("p"),
    )


def _slot_tokens(b: pa.RecordBatch) -> np.ndarray:
    return S.flatten(b.column("w"))[0]


def _least(cost: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The place of the first least cost of each row."""
    at = np.flatnonzero(cost == np.minimum.reduceat(cost, start)[row])
    return at[np.r_[True, row[at][1:] != row[at][:-1]]]


def _blocks(sketch):
    """A mapInArrow function: (h, w) to (key, h), a row per block: the number of the table and the block that leads there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.value
        for b in batches:
            v, n = S.flatten(b.column("w"))
            ids = b.column("h").to_numpy(zero_copy_only=False)[n > 0]
            n = n[n > 0]
            if not len(n):
                continue
            start = np.r_[0, np.cumsum(n)[:-1]]
            row = np.repeat(np.arange(len(n)), n)
            word, at_word = np.unique(v, return_inverse=True)
            count = 2.0 ** ((np.maximum(table[S.slots(word)], 1).astype(float) - 1) / 4)
            weight = np.maximum(count, RARE)
            keys = []
            for k in range(BLOCKS):
                with np.errstate(over="ignore"):
                    x = S.mix(word + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
                u = ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
                cost = (-np.log(u) * weight)[at_word]
                drawn = at_word[_least(cost, start, row)]
                key, draws, width = x[drawn], np.ones(len(n), np.int64), count[drawn]
                wide = np.flatnonzero(width > WIDE)
                for d in range(2, DRAWS + 1):
                    if not len(wide):
                        break
                    cost[at_word == drawn[row]] = np.inf
                    at = _least(cost, start, row)
                    # no other word left: the block stays as it is
                    wide = wide[np.isfinite(cost[at[wide]])]
                    drawn = np.where(np.isin(np.arange(len(n)), wide), at_word[at], drawn)
                    with np.errstate(over="ignore"):
                        key[wide] = S.mix(key[wide] * np.uint64(3) + x[drawn[wide]])
                    draws[wide] = d
                    width[wide] = np.minimum(width[wide], count[drawn[wide]]) / SPREAD
                    wide = wide[width[wide] > WIDE]
                top = np.uint64(k) | (draws - 1).astype(np.uint64) << np.uint64(5)
                keys.append((key >> np.uint64(8)) | top << np.uint64(56))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, BLOCKS))], names=["key", "h"])

    return run


def near_equal(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or exchange of neighbours; two in words of ten letters or more."""
    most = 2 if min(len(a), len(b)) >= 10 else 1
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 3:
        return False
    # an edit changes the set of letters by two at most
    if len(set(a) ^ set(b)) > 2 * most:
        return False
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            cur.append(d)
        if min(cur) > most:
            return False
        prev2, prev = prev, cur
    return prev[-1] <= most


_SPLIT = re.compile(r"[゠-ヿ]+|[㐀-鿿]+|[぀-ゟ]+|[^\W_゠-ヿ㐀-鿿぀-ゟ]+")
_CLIPPED = re.compile(r"(?:\.{3,}|…)(?:\s|$)")


def _is_name(word: str, ordinary) -> bool:
    if not word.isalpha() and any(ch.isdigit() for ch in word):
        return True
    if "゠" <= word[0] <= "ヿ":
        return True
    if "㐀" <= word[0] <= "鿿" or "぀" <= word[0] <= "ゟ":
        return False
    return word[0].isupper() and word.lower() not in LABEL_WORDS and not ordinary(word.lower())


class Parsed:
    """A headline taken apart: words, which of them are names, ordinary or hold digits, whether it was clipped."""

    __slots__ = ("words", "names", "usual", "digits", "clipped")

    def __init__(self, words: list[str], names: set[str], usual: set[str], digits: set[str], clipped: bool):
        self.words, self.names, self.usual, self.digits, self.clipped = words, names, usual, digits, clipped

    @classmethod
    def of(cls, head: str, ordinary) -> Parsed:
        found = _SPLIT.findall(head)
        flat = _flat(found)
        words = [w.lower() for w in found]
        kind: dict[str, bool] = {}
        for w, low in zip(found, words):
            kind[low] = kind.get(low, True) and _is_name(w if not flat else w[:1].upper() + w[1:], ordinary)
        names = {w for w, name in kind.items() if name}
        return cls(words, names, {w for w in kind if ordinary(w)}, {w for w in kind if not w.isalpha() and any(ch.isdigit() for ch in w)}, bool(_CLIPPED.search(head)))


def same_parsed(a: Parsed, b: Parsed) -> bool:
    """same_headline() of two headlines taken apart."""
    if not a.words or not b.words:
        return False
    if not (a.clipped or b.clipped):
        of_a, of_b = set(a.words), set(b.words)
        # a code or number on one side only has no partner, and a name there needs one that differs by a slip
        if not a.digits <= of_b or not b.digits <= of_a:
            return False
        lone_a, lone_b = of_a - of_b, of_b - of_a
        for names, lone in ((a.names & lone_a, lone_b), (b.names & lone_b, lone_a)):
            if any(not any(abs(len(x) - len(y)) < 3 and near_equal(x, y) for y in lone) for x in names):
                return False
    count_a, count_b = Counter(a.words), Counter(b.words)
    only_a, only_b = count_a - count_b, count_b - count_a
    if not only_a and not only_b:
        return True
    common = count_a & count_b
    n_common = sum(common.values())
    most = max(2, 0.34 * n_common)
    if not (a.clipped or b.clipped) and abs(sum(only_a.values()) - sum(only_b.values())) > most:
        return False
    # a word of both is a name if it is written as one in both
    named = lambda w: (w in a.names or w not in count_a) and (w in b.names or w not in count_b)
    if not any(named(w) for w in common):
        return False
    for x in list(only_a):
        if x in a.digits:
            continue
        for y in list(only_b):
            if only_a[x] and only_b[y] and y not in b.digits and abs(len(x) - len(y)) < 3 and near_equal(x, y):
                if x in a.usual or y in b.usual or not named(x) or not named(y):
                    only_a[x] -= 1
                    only_b[y] -= 1
    left_a, left_b = +only_a, +only_b
    if b.clipped:
        left_a = _before_clip(a.words, left_a, count_b)
    if a.clipped:
        left_b = _before_clip(b.words, left_b, count_a)
    if any(named(w) for w in left_a) or any(named(w) for w in left_b):
        return False
    return max(sum(left_a.values()), sum(left_b.values())) <= most


def same_headline(a: str, b: str, ordinary) -> bool:
    """Whether two headlines are one but for small edits of wording, order, case, marks, clipping or publisher tags.

    ordinary(word): whether a lower-case word is an ordinary one. Words in just one of them must be ordinary, or be typing
    slips of an ordinary word of the other, or lie beyond the other's clipped end. A name, code or number on both sides
    without a partner makes them different.
    """
    return same_parsed(Parsed.of(a, ordinary), Parsed.of(b, ordinary))


def _flat(ws: list[str]) -> bool:
    """Whether case says nothing: all words of letters begin with a capital, or none does."""
    letters = [w for w in ws if w[0].isalpha() and w[0].lower() != w[0].upper()]
    return len(letters) > 3 and (all(w[0].isupper() for w in letters) or not any(w[0].isupper() for w in letters))


def _before_clip(words: list[str], left: Counter, other: Counter) -> Counter:
    """left without the words of the longest run at the end of words (or its start, if turned round) that the clipped other lacks."""
    out = Counter(left)
    for x in reversed(words):
        if x in out and out[x] > 0:
            out[x] -= 1
        elif other[x]:
            break
    else:
        return +out
    if sum((+out).values()):
        turned = Counter(left)
        best = +out
        # the clipped one may have been turned round first: its missing words are one inner run
        run: list[str] = []
        longest: list[str] = []
        for x in words:
            if x in left:
                run.append(x)
                longest = max(longest, run, key=len)
            else:
                run = []
        turned.subtract(Counter(longest))
        turned = +turned
        return turned if sum(turned.values()) < sum(best.values()) else best
    return +out


#: A headline taken apart, as text: words, names, ordinary words and words with digits, parted by spaces.
APART = "words string, names string, usual string, digits string, clipped boolean"


def _apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of (h, head, w, o): (h, APART); o are the hashes, among w, of the headline's ordinary words."""
    for b in batches:
        out = []
        for head, hashes, known in zip(b["head"], b["w"], b["o"]):
            parts, known = [w.lower() for w in _SPLIT.findall(head)], set(known)
            usual = {w for w, h in zip(parts, hashes) if h in known} if len(parts) == len(hashes) else set()
            p = Parsed.of(head, usual.__contains__)
            out.append((" ".join(p.words), " ".join(p.names), " ".join(p.usual), " ".join(p.digits), p.clipped))
        yield pd.concat([b[["h"]].reset_index(drop=True), pd.DataFrame(out, columns=["words", "names", "usual", "digits", "clipped"])], axis=1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, columns of APART of both) of the same headline."""
    for b in batches:
        sides = []
        for x in "ab":
            cols = [b.column(c + x).to_pylist() for c in ("words_", "names_", "usual_", "digits_", "clipped_")]
            sides.append([Parsed(w.split(" ") if w else [], set(n.split(" ")), set(u.split(" ")), set(d.split(" ")) if d else set(), c) for w, n, u, d, c in zip(*cols)])
        keep = pa.array([same_parsed(x, y) for x, y in zip(*sides)], pa.bool_())
        yield b.select(["a", "b"]).filter(keep)


#: Columns of a part's tables and the key of its bucketed ones.
TABLES = {
    "heads": ("h bigint, head string, w array<bigint>", "h"),
    "blocks": ("key bigint, h bigint", "key"),
    "links": ("h bigint, p bigint, least bigint", None),
    "words": ("word bigint, n bigint", None),
}


class Index:
    """Fingerprint tables, headlines, links of headlines with pages, and word counts of all accepted rows, in one folder.

    The weights of words are taken when the index is built and kept: fingerprints of later rows must be made by the same.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, sketch: np.ndarray):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.sketch = spark.sparkContext.broadcast(sketch)
        self.parts: list[dict[str, DataFrame]] = []
        self._names: list[str] = []

    @classmethod
    def build(cls, rows: DataFrame, key: str, title: str, url: str, path: str | None = None, buckets: int | None = None) -> Index:
        """The index of rows at path, by default a new folder beside the checkpoints; buckets grow with the rows unless given."""
        return cls.of(stored(prepared(rows, key, title, url), "prepared"), path=path, buckets=buckets)

    @classmethod
    def of(cls, prep: DataFrame, later: DataFrame | None = None, path: str | None = None, buckets: int | None = None) -> Index:
        """build() of prepared rows. later: rows prepared to be appended, whose words are weighed too.

        A word that only later rows use often would pass for a rare one; that loses nothing but makes look-ups dearer.
        """
        spark = prep.sparkSession
        path = path or f"{shared_dir(spark)}/tidemark/index-{uuid.uuid4().hex}"
        every = prep if later is None else prep.unionByName(later)
        partials = stored(every.select("w").mapInArrow(S.slot_counter(_slot_tokens), S.PARTIAL_SCHEMA), "partials")
        sketch = S.table(partials)
        drop_stored(partials)
        if buckets is None:
            buckets = max(12, -(-prep.count() * BLOCKS // BUCKET_ROWS))
        spark.createDataFrame([(buckets, bytearray(sketch.tobytes()))], "buckets int, sketch binary").coalesce(1).write.parquet(f"{path}/base")
        out = cls(spark, path, buckets, sketch)
        out._add(prep)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """An index that build() and append() left at path, with the parts its log names."""
        base = spark.read.parquet(f"{path}/base").first()
        out = cls(spark, path, base["buckets"], np.frombuffer(bytes(base["sketch"]), np.uint8))
        for r in spark.read.schema("at long, part string").parquet(f"{path}/log").orderBy("at").toLocalIterator():
            tables = {}
            for kind, (columns, by) in TABLES.items():
                at = f"{path}/{r['part']}/{kind}"
                tables[kind] = out._known(at, columns, by) if by else spark.read.schema(columns).parquet(at)
            out.parts.append(tables)
        return out

    def append(self, rows: DataFrame, key: str, title: str, url: str) -> DataFrame:
        """Adds rows; returns them as (id, h, p), written, to be looked up."""
        return self._add(stored(prepared(rows, key, title, url), "prepared"))

    def close(self) -> None:
        """Forgets the session's names of the tables; the folder stays."""
        for n in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")

    def drop(self) -> None:
        """close(), and the folder and the weights go too; nothing may read the index any more."""
        self.close()
        self.sketch.destroy()
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _name(self) -> str:
        self._names.append("tidemark_" + uuid.uuid4().hex)
        return self._names[-1]

    def _known(self, at: str, columns: str, by: str) -> DataFrame:
        n = self._name()
        self.spark.sql(f"CREATE TABLE {n} ({columns}) USING parquet OPTIONS (path '{at}') CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS")
        return self.spark.table(n)

    def _bucketed(self, df: DataFrame, at: str, by: str) -> DataFrame:
        n = self._name()
        w = df.repartition(self.buckets, by).write.format("parquet").option("compression", "zstd").option("path", at)
        w.bucketBy(self.buckets, by).sortBy(by).saveAsTable(n)
        return self.spark.table(n)

    def _add(self, prep: DataFrame) -> DataFrame:
        part = "part-" + uuid.uuid4().hex
        at = f"{self.path}/{part}"

        def plain(df: DataFrame, kind: str) -> DataFrame:
            df.write.option("compression", "zstd").parquet(f"{at}/{kind}")
            return self.spark.read.schema(TABLES[kind][0]).parquet(f"{at}/{kind}")

        links = plain(prep.filter("h is not null or p is not null").groupBy("h", "p").agg(F.min("id").alias("least")), "links")
        words = plain(prep.select(F.explode("low").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
        one = prep.filter("h is not null").groupBy("h").agg(F.first(F.struct("head", "w")).alias("x"))
        heads = self._bucketed(one.select("h", "x.head", "x.w"), f"{at}/heads", "h")
        blocks = self._bucketed(heads.select("h", "w").mapInArrow(_blocks(self.sketch), TABLES["blocks"][0]), f"{at}/blocks", "key")
        log = self.spark.createDataFrame([(len(self.parts), part)], "at long, part string").coalesce(1)
        log.write.mode("append").parquet(f"{self.path}/log")
        self.parts.append({"heads": heads, "blocks": blocks, "links": links, "words": words})
        return prep.select("id", "h", "p")

    def _of(self, kind: str, keys: DataFrame, by: str, how: str = "inner") -> DataFrame:
        """The rows of a table, of all parts, that have a key of keys (a written table); few keys are pushed into the scan."""
        few = [r[0] for r in keys.select(by).distinct().limit(FEW_KEYS + 1).collect()] if stored_bytes(keys) < FEW_BYTES else None
        out = None
        for p in self.parts:
            t = p[kind].filter(F.col(by).isin(few)) if few is not None and len(few) <= FEW_KEYS else p[kind]
            # the keys are the build side whatever their number: the index keeps its buckets
            t = t.join(small_side(keys).hint("shuffle_hash"), by, how)
            out = t if out is None else out.unionByName(t)
        return out

    def hits(self, heads: DataFrame) -> DataFrame:
        """(q, h, equal): headlines of the index that share blocks with the headlines q of heads (h, w), and how many."""
        draws = F.shiftrightunsigned("key", 61) + 1
        q = stored(heads.mapInArrow(_blocks(self.sketch), TABLES["blocks"][0]).withColumnRenamed("h", "q"), "lookups")
        return self._of("blocks", q, "key").filter("h <> q").groupBy("q", "h").agg(F.sum(draws).alias("equal"))

    def ties(self, frontier: DataFrame) -> DataFrame:
        """(a, b): verified ties between the headlines of frontier (h) and any other headline of the index."""
        mine = stored(self._of("heads", frontier, "h", "left_semi").select("h", "w").dropDuplicates(["h"]), "mine")
        near = self.hits(mine).filter(F.lit(BLOCKS) - F.col("equal") <= RADIUS)
        pairs = stored(near.select(F.least("h", "q").alias("a"), F.greatest("h", "q").alias("b")).distinct(), "hits")
        need = stored(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "need")
        texts = stored(self._of("heads", need, "h", "left_semi").dropDuplicates(["h"]), "texts")
        words = stored(texts.select("h", F.explode(F.array_distinct("w")).alias("word")), "words")
        asked = stored(words.select("word").distinct(), "asked")
        usual = self._of("words", asked, "word").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= ORDINARY).select("word")
        usual = words.join(small_side(stored(usual, "usual")), "word").groupBy("h").agg(F.collect_list("word").alias("o"))
        texts = texts.join(usual, "h", "left").withColumn("o", F.coalesce("o", F.array().cast("array<bigint>")))
        texts = stored(texts.select("h", "head", "w", "o").mapInPandas(_apart, "h long, " + APART), "texts")
        side = lambda x: texts.select(*[F.col(c).alias(x if c == "h" else f"{c}_{x}") for c in texts.columns])
        return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify, "a long, b long"), "ties")


def repeats(index: Index, batch: DataFrame, rounds: int = 1000) -> DataFrame:
    """(first_id, candidate_id): each row of batch (id, h, p, as append() returned it) whose item the index has under a lower id, with the item's least id.

    Headlines and pages are searched in turn, until a round finds none that hasn't been; rounds is a safety bound, beyond
    which an error is raised.
    """
    new_h = seen_h = stored(batch.select("h").filter("h is not null").distinct(), "heads")
    new_p = seen_p = stored(batch.select("p").filter("p is not null").distinct(), "pages")
    links, ties = [], []
    for _ in range(rounds):
        ties.append(index.ties(new_h))
        found = index._of("links", new_h, "h", "left_semi").unionByName(index._of("links", new_p, "p", "left_semi"))
        links.append(stored(found.groupBy("h", "p").agg(F.min("least").alias("least")), "links"))
        ends = ties[-1].select(F.explode(F.array("a", "b")).alias("h")).unionByName(links[-1].select("h").filter("h is not null"))
        new_h = stored(ends.distinct().join(seen_h, "h", "left_anti"), "heads")
        new_p = stored(links[-1].select("p").filter("p is not null").distinct().join(seen_p, "p", "left_anti"), "pages")
        if new_h.isEmpty() and new_p.isEmpty():
            break
        seen_h, seen_p = stored(seen_h.unionByName(new_h), "heads"), stored(seen_p.unionByName(new_p), "pages")
    else:
        raise RuntimeError(f"repeats: rows left to look up after {rounds} rounds")
    link = _union(links)
    member = components(_union(ties).unionByName(link.filter("h is not null and p is not null").select(F.col("h").alias("a"), F.col("p").alias("b"))))
    member = member.withColumnRenamed("id", "node")
    node = F.coalesce("h", "p").alias("node")
    rooted = lambda df: df.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted(link.select(node, "least")).groupBy("root").agg(F.min("least").alias("first_id"))
    mine = rooted(batch.select(F.col("id").alias("candidate_id"), node).filter("node is not null").distinct())
    return mine.join(first, "root").filter("first_id < candidate_id").select("first_id", "candidate_id").distinct()


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def batch_repeats(history: DataFrame, batches: DataFrame, key: str = "candidate_id", title: str = "title", url: str = "url") -> DataFrame:
    """repeats() of batches against history and against themselves.

    Ids must grow with time, as first means the least id. Null and blank titles have no fingerprint and null urls no page;
    such rows match by the other alone. Repeated rows of an id count once; empty tables give no rows; other columns are
    not read, rows without an id are left out.
    """
    old, new = (stored(prepared(rows, key, title, url), "prepared") for rows in (history, batches))
    index = Index.of(old, later=new)
    found = stored(repeats(index, index._add(new)), "repeats")
    # the index was made for this call alone
    index.drop()
    drop_stored(old)
    drop_stored(new)
    return found
