"""Near-duplicate records with small edits: groups of rows by word overlap or page, without comparing all with all.

Exact, in five steps.
1. Each text becomes a multiset of 64-bit word hashes (a word's second occurrence is another token). Equal multisets are
   tied to their first row at once and only that row goes on, so copies cost nothing later.
2. Tokens are ordered by rarity, taken from a frequency sketch of fixed size. If words-in-common / words-in-either of x and
   y is at least t, they share a token within the first |x| - ceil(t |x|) + 1 of the larger and the first
   |y| - ceil(2t/(1+t) |y|) + 1 of the smaller; only these tokens are block keys. A token the sketch has seen once is in no
   other row and is skipped; one more frequent than `widest` is replaced by its pairs with each possible next common token.
   Keys whose block may still be too wide are salted: the larger sides are spread, the smaller sides replicated.
3. Within a block rows are compared by a 128-bit parity sketch (each token flips one bit): its Hamming distance is never
   more than the number of tokens in just one of the rows, which t bounds by (1-t)/(1+t) (|x|+|y|). All blocks are compared
   bit-sliced: the bit planes of 64 consecutive rows lie in one word, whatever block they belong to, and a row is compared
   with the words that its block spans, the lanes of other blocks and of sizes no tie allows being masked; carry-save
   counters add plane after plane for many (row, word) at once, and words in which every lane has passed its radius are
   abandoned. Rows stream by: a block too long for one buffer is compared buffer with buffer.
4. The few pairs left are verified on the tokens themselves.
5. Ties by text and by page are joined to groups by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import sketch as S
from tidemark.llm import words as W
from tidemark.llm.pages import page_key_column
from tidemark.operators.components import components
from tidemark.session import drop_stored, small_side, stored

BITS = 128
PLANE_STEP = 8
#: Block rows taken together, and (row, word) comparisons of one step.
BUFFER, STEP = 400_000, 1 << 15


def tokens(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, row numbers): hashes of a row's words, the k-th occurrence of a word being a token of its own."""
    row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    order = S.grouped_order(row, values)
    h, r = values[order], row[order]
    if not len(h):
        return h, r
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.arange(len(h))
    start = np.maximum.accumulate(np.where(new, at, 0))
    occurrence = (at - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        again = S.mix(h + occurrence * np.uint64(0x9E3779B97F4A7C15))
    return np.where(occurrence == 0, h, again), r


def parity(h: np.ndarray, r: np.ndarray, n_rows: int) -> np.ndarray:
    """(rows, 2) uint64: bit k is the parity of the number of a row's tokens that hash to k."""
    bit = (S.mix(h ^ np.uint64(0xD1B54A32D192ED03)) & np.uint64(BITS - 1)).astype(np.int64)
    counts = np.bincount(r * BITS + bit, minlength=n_rows * BITS).reshape(n_rows, BITS) & 1
    return np.packbits(counts.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(n_rows, BITS // 64)


def _words(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, words of each row) of title plus summary in their comparable form; no words where the summary is null or blank."""
    title, summary = pa.compute.fill_null(b.column("title"), ""), b.column("summary")
    has = pa.compute.fill_null(pa.compute.not_equal(pa.compute.utf8_trim(summary, " "), ""), False)
    both = pa.compute.binary_join_element_wise(title, summary, " ")
    return W.hashed(W.comparables(pa.compute.if_else(has, both, "")))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, page, title, summary): rows (id, page, two content hashes), and partial frequency counts."""
    held: list[np.ndarray] = []
    size = 0
    names = ["id", "page", "c1", "c2", "range", "slots", "counts"]
    for b in batches:
        v, n = _words(b)
        h, r = tokens(v, n)
        with np.errstate(over="ignore"):
            c1, c2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(h):
                starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                c1[r[starts]] = np.add.reduceat(S.mix(h), starts)
                c2[r[starts]] = np.add.reduceat(S.mix(h ^ np.uint64(0xA0761D6478BD642F)), starts)
        empty = pa.array(n == 0)
        pick = lambda c: pa.compute.if_else(empty, pa.scalar(None, pa.int64()), pa.array(c.view(np.int64)))
        none = lambda t: pa.nulls(b.num_rows, t)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("page"), pick(c1), pick(c2), none(pa.int32()), none(pa.binary()), none(pa.binary())], names=names
        )
        held.append(S.slots(h))
        size += len(h)
        if size >= S.FLUSH:
            yield _counts(held, names)
            held, size = [], 0
    if size:
        yield _counts(held, names)


def _counts(held: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    p = S.partial(held, S.BITS)
    none = pa.nulls(p.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, none, *p.columns], names=names)


def _keys(sketch, t: float, widest: int):
    """A mapInArrow function: (id, title, summary) to block rows (key, salt, id, n, s1, s2, part); part 1: may be the smaller side, 2: the larger, 3: both."""
    exact = Fraction(t).limit_denominator(1000)
    half = 2 * exact / (1 + exact)
    wide = S.level(np.array([widest]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.value
        for b in batches:
            v, n = _words(b)
            h, r = tokens(v, n)
            ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(h):
                continue
            par = parity(h, r, len(n))
            q = table[S.slots(h)]
            order = S.grouped_order(r, h, q)
            h, r, q = h[order], r[order], q[order]
            first = np.zeros(len(n), np.int64)
            first[1:] = np.cumsum(n)[:-1]
            pos = np.arange(len(h)) - first[r]
            # exact ceilings in integers
            p, d = exact.numerator, exact.denominator
            probe = n - (-(-n * p // d)) + 1
            hp, hd = half.numerator, half.denominator
            index = n - (-(-n * hp // hd)) + 1
            plain = (pos < probe[r]) & (q > 1) & (q <= wide)
            k, rr = [h[plain]], [r[plain]]
            part = [np.where(pos[plain] < index[r[plain]], 3, 2)]
            salt = [np.zeros(plain.sum(), np.int32)]
            many = np.flatnonzero((pos < probe[r]) & (q > wide))
            if len(many):
                # pairs of a frequent token with each token that can be the next common one
                reach = np.minimum(probe[r[many]] + 1, n[r[many]]) - pos[many] - 1
                a = np.repeat(many, np.maximum(reach, 0))
                step = np.arange(len(a)) - np.repeat(np.cumsum(np.maximum(reach, 0)) - np.maximum(reach, 0), np.maximum(reach, 0))
                c = a + 1 + step
                with np.errstate(over="ignore"):
                    kk = S.mix(h[a] * np.uint64(3) + h[c])
                small = (pos[a] < index[r[a]]) & (pos[c] < index[r[a]] + 1)
                # expected width, as if tokens were independent to half
                est = 2.0 ** ((q[a].astype(float) - 1) / 4) * np.minimum(1.0, 2.0 ** ((q[c].astype(float) - 1) / 4) / max(2.0 ** ((float(table.max()) - 1) / 4), 1.0)) ** 0.5
                parts = np.maximum(np.ceil(est / widest), 1).astype(np.int64)
                # larger side: one salt; smaller side: all of them
                k.append(kk)
                rr.append(r[a])
                part.append(np.full(len(a), 2))
                salt.append((S.mix(ids[r[a]].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int32))
                s = np.flatnonzero(small)
                rep = np.repeat(s, parts[s])
                sal = np.arange(len(rep)) - np.repeat(np.cumsum(parts[s]) - parts[s], parts[s])
                k.append(kk[rep])
                rr.append(r[a][rep])
                part.append(np.full(len(rep), 1))
                salt.append(sal.astype(np.int32))
            k, rr, part, salt = np.concatenate(k), np.concatenate(rr), np.concatenate(part), np.concatenate(salt)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(k.view(np.int64)), pa.array(salt), pa.array(ids[rr]), pa.array(n[rr].astype(np.int32)),
                    pa.array(par[rr, 0].view(np.int64)), pa.array(par[rr, 1].view(np.int64)), pa.array(part.astype(np.int8)),
                ],
                names=["key", "salt", "id", "n", "s1", "s2", "part"],
            )

    return run


KEY_SCHEMA = "key long, salt int, id long, n int, s1 long, s2 long, part byte"


def _add(counter: list[np.ndarray], ones: np.ndarray, weight: int) -> None:
    """Adds a bit of the given weight (its place in counter) into the bit-sliced counter."""
    k = weight
    while True:
        if k == len(counter):
            counter.append(ones)
            return
        counter[k], ones = counter[k] ^ ones, counter[k] & ones
        if not ones.any():
            return
        k += 1


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def _add_planes(counter: list[np.ndarray], x: list[np.ndarray]) -> None:
    """Adds eight planes to the counter with carry-save adders: seven adders instead of eight rippling additions."""
    one = counter[0]
    two_a, one = _csa(one, x[0], x[1])
    two_b, one = _csa(one, x[2], x[3])
    two_c, one = _csa(one, x[4], x[5])
    two_d, one = _csa(one, x[6], x[7])
    counter[0] = one
    four_a, two = _csa(counter[1], two_a, two_b)
    four_b, two = _csa(two, two_c, two_d)
    counter[1] = two
    eight, counter[2] = _csa(counter[2], four_a, four_b)
    _add(counter, eight, 3)


def _beyond(counter: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """Lanes whose count is greater than the radius of their place."""
    gt = np.zeros_like(counter[0])
    eq = ~gt
    for k in range(len(counter) - 1, -1, -1):
        on = (np.uint64(0) - (radius >> np.uint64(k) & np.uint64(1))).astype(np.uint64)
        gt |= eq & counter[k] & ~on
        eq &= ~(counter[k] ^ on)
    gt[radius >> np.uint64(len(counter)) > 0] = 0
    return gt


def planes(s: np.ndarray) -> np.ndarray:
    """(BITS, words) uint64: bit plane k holds bit k of 64 rows a word."""
    rows = len(s)
    bits = np.unpackbits(s.view(np.uint8).reshape(rows, BITS // 8), axis=1, bitorder="little")
    full = np.zeros((BITS, -(-rows // 64) * 64), np.uint8)
    full[:, :rows] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def _lanes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Words with the bits low to high - 1 set, 0 <= low < high <= 64."""
    return (~np.uint64(0) << low.astype(np.uint64)) & (~np.uint64(0) >> (64 - high).astype(np.uint64))


def sliced_pairs(
    q: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, radius, open_lanes: np.ndarray | None = None, first_check: int = 64
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows of q and those of rows low[i] to high[i] - 1 within a radius, in parts, by bit-sliced counting.

    radius(i, last): the greatest radius that a row i needs among rows up to last of one word. open_lanes: a plane of the rows to
    compare with at all. Words in which all lanes are beyond it are abandoned.
    """
    vertical = planes(rows)
    some = np.flatnonzero(high > low)
    first, last = low[some] // 64, (high[some] - 1) // 64
    for x, y in _spans(last - first + 1, STEP):
        n_words = (last - first + 1)[x:y]
        total = int(n_words.sum())
        part_q = np.repeat(some[x:y], n_words)
        part_w = np.arange(total) - np.repeat(np.cumsum(n_words) - n_words, n_words) + np.repeat(first[x:y], n_words)
        # one row may span more words than a step holds
        for z in range(0, total, STEP):
            qi, wi = part_q[z : z + STEP], part_w[z : z + STEP]
            top = np.minimum(high[qi] - wi * 64, 64)
            mask = _lanes(np.maximum(low[qi] - wi * 64, 0), top)
            if open_lanes is not None:
                mask &= open_lanes[wi]
            limit = radius(qi, wi * 64 + top - 1).astype(np.uint64)
            keep = mask != 0
            qi, wi, mask, limit = qi[keep], wi[keep], mask[keep], limit[keep]
            zero = np.zeros(len(qi), np.uint64)
            counter = [zero, zero.copy(), zero.copy()]
            own = q[qi]
            for k in range(0, BITS, PLANE_STEP):
                if not len(qi):
                    break
                half = own[:, k // 64]
                _add_planes(
                    counter,
                    [vertical[k + x][wi] ^ (np.uint64(0) - (half >> np.uint64((k + x) % 64) & np.uint64(1))) for x in range(PLANE_STEP)],
                )
                done = k + PLANE_STEP
                if done >= first_check and done % 16 == 0 and done < BITS:
                    alive = (~_beyond(counter, limit) & mask) != 0
                    if alive.mean() < 0.75:
                        qi, wi, mask, limit, own = qi[alive], wi[alive], mask[alive], limit[alive], own[alive]
                        counter = [c[alive] for c in counter]
            if not len(qi):
                continue
            near = ~_beyond(counter, limit) & mask
            hit = np.flatnonzero(near)
            if len(hit):
                bits = np.unpackbits(near[hit].view(np.uint8).reshape(len(hit), 8), axis=1, bitorder="little")
                w, lane = np.nonzero(bits)
                yield qi[hit[w]], wi[hit[w]] * 64 + lane


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _spans(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to about most."""
    c = np.cumsum(size)
    lo = 0
    while lo < len(size):
        base = c[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(c, base + most, side="right")))
        yield lo, hi
        lo = hi


class _Rows:
    """Block rows in the order of (key, salt, n)."""

    def __init__(self, key, salt, ids, n, s, part):
        self.key, self.salt, self.ids, self.n, self.s, self.part = key, salt, ids, n, s, part

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, at) -> _Rows:
        return _Rows(self.key[at], self.salt[at], self.ids[at], self.n[at], self.s[at], self.part[at])

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        col = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        return cls(col("key"), col("salt"), col("id"), col("n").astype(np.int64), np.stack([col("s1"), col("s2")], axis=1).view(np.uint64), col("part"))

    @classmethod
    def joined(cls, held: list[_Rows]) -> _Rows:
        return held[0] if len(held) == 1 else cls(*[np.concatenate([getattr(h, c) for h in held]) for c in ("key", "salt", "ids", "n", "s", "part")])

    def group(self) -> np.ndarray:
        return np.cumsum(np.r_[False, (self.key[1:] != self.key[:-1]) | (self.salt[1:] != self.salt[:-1])])


def _pairs(t: float):
    """A mapInArrow function over block rows sorted by (key, salt, n): (a, b), a < b, within the radius."""
    exact = Fraction(t).limit_denominator(1000)
    up, down = exact.denominator, exact.numerator
    num, den = (1 - exact).numerator * (1 + exact).denominator, (1 - exact).denominator * (1 + exact).numerator

    def compare(q: _Rows, q_group: np.ndarray, r: _Rows, r_group: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Smaller sides of q against the larger sides of r in the same group, of at least their size."""
        at = r_group << 32 | r.n
        mine = np.flatnonzero((q.part & 1) > 0)
        g, n = q_group[mine], q.n[mine]
        low, high = np.searchsorted(at, g << 32 | n), np.searchsorted(at, g << 32 | n * up // down, side="right")
        # a row alone in its range has no one to be compared with
        wanted = high - low > (1 if q is r else 0)
        mine, n, low, high = mine[wanted], n[wanted], low[wanted], high[wanted]
        larger = np.zeros(-(-len(r) // 64) * 64, np.uint8)
        larger[: len(r)] = (r.part & 2) > 0
        larger = np.packbits(larger, bitorder="little").view(np.uint64)
        s, ids = q.s[mine], q.ids[mine]
        for i, j in sliced_pairs(s, r.s, low, high, lambda i, last: (n[i] + r.n[last]) * num // den, larger):
            d = _distance(s[i], r.s[j])
            ok = (d * den <= (n[i] + r.n[j]) * num) & (ids[i] != r.ids[j])
            a, b = np.minimum(ids[i], r.ids[j])[ok], np.maximum(ids[i], r.ids[j])[ok]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def within(x: _Rows) -> Iterator[pa.RecordBatch]:
        g = x.group()
        yield from compare(x, g, x, g)

    def across(x: _Rows, y: _Rows) -> Iterator[pa.RecordBatch]:
        gx, gy = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        yield from compare(x, gx, y, gy)
        yield from compare(y, gy, x, gx)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Rows] = []
        size = 0
        # earlier buffers of a block that goes on
        open_block: list[_Rows] = []

        def emit(x: _Rows, ended: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_block, held, size
            held, size = [], 0
            if open_block:
                o = open_block[0]
                ends = np.flatnonzero((x.key != o.key[0]) | (x.salt != o.salt[0]))
                head = x[: ends[0]] if len(ends) else x
                for o in open_block:
                    yield from across(head, o)
                if not len(ends):
                    yield from within(x)
                    open_block.append(x)
                    return
                yield from within(head)
                open_block, x = [], x[ends[0] :]
            if ended:
                yield from within(x)
                return
            start = int(np.flatnonzero(np.r_[True, (x.key[1:] != x.key[:-1]) | (x.salt[1:] != x.salt[:-1])])[-1])
            if start:
                yield from within(x[:start])
            rest = x[start:]
            if len(rest) * 2 > BUFFER:
                yield from within(rest)
                open_block = [rest]
            else:
                held, size = [rest], len(rest)

        for batch in batches:
            if batch.num_rows:
                held.append(_Rows.of(batch))
                size += batch.num_rows
                if size >= BUFFER:
                    yield from emit(_Rows.joined(held), False)
        if held:
            yield from emit(_Rows.joined(held), True)

    return run


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v, n = _words(b)
        h, r = tokens(v, n)
        offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
        arr = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("id"), arr], names=["id", "t"])


def star(rows: DataFrame, key: list[str]) -> DataFrame:
    """(a, b): each row of a key that several ids share, tied to the key's least id. Pre-aggregated, so a hot key is one row of the small side."""
    least = rows.groupBy(*key).agg(F.min("id").alias("a"), F.max("id").alias("_most")).filter("a <> _most").drop("_most")
    return rows.join(least, key).filter("id <> a").select("a", F.col("id").alias("b"))


def text_ties(rows: DataFrame, key: str, title: str, summary: str, t: float = 0.75, widest: int = 8192, scan: DataFrame | None = None) -> DataFrame:
    """(a, b): enough ties by text to connect all rows whose word multisets overlap by t or more; exact, each tie verified."""
    spark = rows.sparkSession
    raw = rows.select(F.col(key).cast("long").alias("id"), F.col(title).alias("title"), F.col(summary).alias("summary"))
    if scan is None:
        scan = scanned(rows, key, None, title, summary)
    table = S.table(scan.filter("range is not null").select("range", "slots", "counts"))
    sketch = spark.sparkContext.broadcast(table)
    copies = stored(star(scan.filter("c1 is not null").select("id", "c1", "c2"), ["c1", "c2"]).distinct(), "copies")
    only = raw.join(small_side(copies.select(F.col("b").alias("id")).distinct()), "id", "left_anti")
    keys = only.mapInArrow(_keys(sketch, t, widest), KEY_SCHEMA)
    blocks = keys.repartition("key", "salt").sortWithinPartitions("key", "salt", "n")
    pairs = stored(blocks.mapInArrow(_pairs(t), "a long, b long").distinct(), "pairs")
    need = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "need")
    # joined before the words are taken, so that only the rows needed are taken apart again
    some = raw.join(small_side(need), "id", "left_semi")
    texts = some.mapInArrow(_token_rows, "id long, t array<bigint>").dropDuplicates(["id"])
    texts = stored(texts, "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b"
    )
    common = F.size(F.array_intersect("ta", "tb"))
    exact = Fraction(t).limit_denominator(1000)
    ok = common * exact.denominator >= (F.size("ta") + F.size("tb") - common) * exact.numerator
    ties = stored(both.filter(ok & (common > 0)).select("a", "b").unionByName(copies), "ties")
    for old in (pairs, need, texts, copies):
        drop_stored(old)
    return ties


def scanned(rows: DataFrame, key: str, url: str | None, title: str, summary: str) -> DataFrame:
    """One pass over the texts: content hashes and page hash per row, and the token frequencies in parts."""
    page = page_key_column(F.col(url)) if url else F.lit(None).cast("string")
    r = rows.select(
        F.col(key).cast("long").alias("id"),
        F.when(page.isNotNull(), F.xxhash64(page)).alias("page"),
        F.col(title).alias("title"),
        F.col(summary).alias("summary"),
    )
    return stored(r.mapInArrow(_scan, "id long, page long, c1 long, c2 long, range int, slots binary, counts binary"), "scan")


def groups(rows: DataFrame, key: str, title: str, summary: str, url: str, t: float = 0.75) -> DataFrame:
    """(id, root): each row in a group of two or more, with the least id of its group.

    Rows are tied by word overlap of at least t over title plus summary (both summaries non-empty), or by the same page.
    Null titles count as empty, null and blank urls as no page; repeated rows of a key count once; very long texts are
    taken whole; an empty table gives no rows. Other columns are not read, rows without a key are left out.
    """
    rows = rows.filter(F.col(key).isNotNull())
    scan = scanned(rows, key, url, title, summary)
    pages = star(scan.filter("page is not null").select("id", "page"), ["page"]).distinct()
    ties = text_ties(rows, key, title, summary, t, scan=scan)
    return components(ties.unionByName(pages))


def group_pairs(membership: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs within the groups, as the result is defined; the join is on the group."""
    a = membership.select(F.col("id").alias("id_a"), "root")
    b = membership.select(F.col("id").alias("id_b"), "root")
    return a.join(b, "root").filter("id_a < id_b").select("id_a", "id_b")
