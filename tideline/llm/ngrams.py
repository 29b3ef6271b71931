"""LM scoring with a log-frequency Bloom filter.

N-grams of two, three and four words of the training texts are counted, counts are quantised to levels (level q stands
for 2**(q-1) and more), and an n-gram of level q is put into the filter q times, as (n-gram, 1) .. (n-gram, q). A reader
probes levels upwards until one is missing. The filter of an order lies in segments, as many as the corpus asks for; each
is filled and read by one task, with GRAM_BITS bits for each n-gram and level that it stores, so that the rate of false
hits (which make reads too high, never too low) is the same for any corpus. Word counts are exact. Documents are dealt to
groups, and each group is sent the counts of just its own words and n-grams, so no table of either is ever broadcast.
Counts of groups are added up in a tree: no task holds a bucket's counts from more than FAN groups, however common a word.

P1(w) = (f(w) + 1) / (N + V + 1); P(w | h) = (f(h, w) + K * P(w | h')) / (f(h) + K), where h' is h without its first word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, fold_of, hash_words, mix, remove, slices, written

#: Words of the longest n-grams; bits of the filter for a stored n-gram and level (with two probes of a level: 0.4 % false hits).
ORDERS, GRAM_BITS = 4, 32
#: The highest level that a count of 63 bits can have.
TOP = 63
#: Text bytes of a group of documents, on average; groups whose counts one task adds up; weight of the shorter n-gram's probability.
GROUP_BYTES, FAN, PRIOR = 8 << 20, 512, 4.0
#: Segments of an order, buckets of words at least.
SEGMENTS = 32
END = np.uint64(0x5EED0F7E7C0DE5)
_LOW = np.uint64((1 << 40) - 1)


def tokens_of(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a run of texts, each text closed by END, and the number of tokens of each text."""
    words, sizes = hash_words([t.translate(LOWER) for t in run])
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = words
    return out, sizes + 1


def longer(grams: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that ends at each token, from those of n - 1 words; before a text stands END."""
    before = np.empty_like(grams)
    before[1:] = grams[:-1]
    before[np.cumsum(sizes) - sizes] = END
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + (tokens ^ (tokens >> np.uint64(29))))


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)) of positive counts."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


class LogBloom:
    """A filter in segments: a key's segment is given by its top bits, its places by the lower 40 bits and the level."""

    def __init__(self, bits: np.ndarray, top: int = TOP):
        self.bits, self.top = bits, top  # (segments, bytes of one) of uint8; the highest level stored

    @staticmethod
    def segment(keys: np.ndarray, segments: int) -> np.ndarray:
        """Ascending with the keys: sorted keys stand by segment."""
        return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def places(keys: np.ndarray, q: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The two bits of a key at a level: the halves of one hash, each cut to the size."""
        x = mix((keys & _LOW) + np.uint64(q * 0xD1B54A32D192ED03 & (2**64 - 1)))
        return tuple((h * np.uint64(size) >> np.uint64(32)).view(np.int64) for h in (x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)))

    @staticmethod
    def room(counts: np.ndarray) -> int:
        """Bits for a segment that holds keys with these counts: GRAM_BITS for each level of each, in whole bytes."""
        return max(64, GRAM_BITS * int(level(counts).sum()))

    @staticmethod
    def fill(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        """The bytes of one segment of `size` bits."""
        bits = np.zeros(size, bool)
        q = level(counts)
        for at in range(1, int(q.max(initial=0)) + 1):
            for places in LogBloom.places(keys[q >= at], at, size):
                bits[places] = True
        return np.packbits(bits, bitorder="little")

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count that the highest unbroken level stands for (2**(level - 1)), 0 where level 1 is missing."""
        segments, size = self.bits.shape[0], self.bits.shape[1] * 8
        out = np.zeros(len(keys))
        todo, q = np.arange(len(keys)), 1
        segment = self.segment(keys, segments)
        while len(todo) and q <= self.top:
            held = True
            for at in self.places(keys[todo], q, size):
                held &= self.bits[segment[todo], at >> 3] >> (at & 7).astype(np.uint8)
            todo = todo[held & 1 == 1]
            out[todo] = 2.0 ** (q - 1)
            q += 1
        return out


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts by key, sorted by key."""
    order = np.argsort(keys)
    keys = keys[order]
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[cuts], np.add.reduceat(counts[order], cuts) if len(cuts) else counts[:0]


def _shared(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The keys of all groups with the sums of their counts, sorted; and where each group's keys stand among them."""
    every, sizes = np.concatenate(keys), np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(every)
    every = every[order]
    fresh = np.concatenate(([True], every[1:] != every[:-1]))
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(fresh) - 1
    cuts = np.flatnonzero(fresh)
    return every[cuts], np.add.reduceat(np.concatenate(counts)[order], cuts), np.split(place, np.cumsum(sizes)[:-1])


def _counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each is learnt from. A key's top bit gives way to the mark of learning."""
    x = np.sort(keys << np.uint64(1) | learn.astype(np.uint64))
    k = x >> np.uint64(1)
    cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[cuts] << np.uint64(1), np.add.reduceat((x & np.uint64(1)).astype(np.int64), cuts)


def _cut(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, up to) of each part that sorted keys have."""
    cuts = np.searchsorted(LogBloom.segment(keys, parts), np.arange(parts + 1)).tolist()
    return [(j, x, y) for j, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]


def _short(keys: np.ndarray) -> bytes:
    """The lower five bytes of each key."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(keys: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(keys) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(keys, np.uint8).reshape(-1, width)
    return wide.view(np.uint64).ravel()


def _numbers(x: np.ndarray) -> bytes:
    """Numbers in one, four or eight bytes each."""
    return x.astype(np.uint8 if (top := int(x.max(initial=0))) < 1 << 8 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _read(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 4: np.uint32, 8: np.uint64}[len(data) // max(n, 1) or 1]).astype(np.int64)


def _levels(keys: list[np.ndarray], counts: list[np.ndarray], bits: int | None) -> list[bytes]:
    """Fills a segment with the keys of all groups and reads it for each: levels as bytes, 0 where level 1 is missing."""
    k, c, places = _shared(keys, counts)
    held = c > 0
    filled = LogBloom.fill(k[held], c[held], bits or LogBloom.room(c[held]))
    read = LogBloom(filled[None, :], top=int(level(c[held]).max(initial=0))).counts(k)
    q = np.where(read > 0, level(np.maximum(read, 1)), 0).astype(np.uint8)
    return [q[x].tobytes() for x in places]


SENT, TOTALS = "group long, bucket long, keys binary, counts binary", "group long, bucket long, totals binary, n long, v long"
#: Columns of SENT: buckets are numbered through all orders, those of words first.
_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _table(rows: list[tuple], names: list[str], kinds=_KINDS) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _totals(counted: DataFrame, groups: int, words: int, bits: int | None, fan: int) -> DataFrame:
    """(TOTALS) what all groups' counts come to, for each row of `counted` (SENT): of words the sums, of n-grams the levels in the filter."""

    def opened(t: pa.Table) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
        bucket = t.column("bucket")[0].as_py()
        keys = [_long(x, 8 if bucket < words else 5) for x in t.column("keys").to_pylist()]
        return bucket, keys, [_read(c, len(k)) for c, k in zip(t.column("counts").to_pylist(), keys, strict=True)]

    def root(t: pa.Table) -> pa.Table:
        bucket, keys, counts = opened(t)
        n = v = 0
        if bucket < words:
            _, c, places = _shared(keys, counts)
            back, n, v = [_numbers(c[x]) for x in places], int(c.sum()), int((c > 0).sum())
        else:
            back = _levels(keys, counts, bits)
        return pa.table([t.column("group"), t.column("bucket"), pa.array(back, pa.binary()), pa.array([n] * len(keys), pa.int64()), pa.array([v] * len(keys), pa.int64())], names=["group", "bucket", "totals", "n", "v"])

    def merge(t: pa.Table) -> pa.Table:
        bucket, keys, counts = opened(t)
        k, c = _packed(np.concatenate(keys), np.concatenate(counts))
        return _table([(t.column("parent")[0].as_py(), bucket, k.tobytes() if bucket < words else _short(k), _numbers(c))], ["group", "bucket", "keys", "counts"])

    def pick(t: pa.Table, found: pa.Table) -> pa.Table:
        k, _, places = _shared(*opened(t)[1:])
        c = _read(found.column("totals")[0].as_py(), len(k))
        back = [_numbers(c[x]) for x in places]
        return pa.table([t.column("group"), t.column("bucket"), pa.array(back, pa.binary()), *(pa.array([found.column(x)[0].as_py()] * len(back), pa.int64()) for x in ("n", "v"))], names=["group", "bucket", "totals", "n", "v"])

    if groups <= fan:
        return counted.groupBy("bucket").applyInArrow(root, TOTALS)
    parents = math.ceil(groups / fan)
    mine = counted.withColumn("parent", F.pmod("group", F.lit(parents)))
    merged = written(mine.groupBy("parent", "bucket").applyInArrow(merge, SENT), "merged")
    found = _totals(merged, parents, words, bits, fan).withColumnRenamed("group", "up").withColumnRenamed("bucket", "of")
    return mine.groupBy("parent", "bucket").cogroup(found.groupBy("up", "of")).applyInArrow(pick, TOTALS)


def score(docs: DataFrame, mod: int = 7, held: int = 2, bits: int | None = None, orders: int = ORDERS, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Words are counted over all rows that are not held out (crc32 of doc_id as text, mod 7, is 2; null as 'null'). A
    null text is empty: its one token is the end. Repeated rows are counted and scored each. With no training rows
    all counts are 0 and both scores come from the smoothing alone. `bits` gives each order's filter a fixed size, whatever
    the number of n-grams. Words and pairs are counted in one pass, each longer order in its own, whose shuffles go before the next.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (fold_of(F.col("doc_id"), mod) == held).alias("held_out"))
    size = kept.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    groups = max(1, math.ceil(size / GROUP_BYTES))
    words = segments = max(SEGMENTS, groups // 2)  # buckets 0 .. words - 1 hold words, the next `segments` pairs, and so on
    grouped = kept.withColumn("group", F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64)), F.lit(groups)))

    def grams_of(t: pa.Table, upto: int):
        """(first row, sizes, hashes of the n-grams at each token for n = 1 .. upto) of the texts, a run at a time."""
        for first, part in slices(t.column("text").to_pylist()):
            tokens, sizes = tokens_of(part)
            grams = [tokens]
            while len(grams) < upto:
                grams.append(longer(grams[-1], tokens, sizes))
            yield first, sizes, grams

    def counter(these: list[int]):
        return lambda t: count(t, these)  # Spark looks at the number of arguments

    def count(t: pa.Table, these: list[int]) -> pa.Table:  # of a group: distinct n-grams with their counts in training texts, by bucket
        group, learn, rows = t.column("group")[0].as_py(), ~t.column("held_out").to_numpy(zero_copy_only=False), []
        found, marks = [], []
        for first, sizes, grams in grams_of(t, these[-1]):
            found.append(grams)
            marks.append(np.repeat(learn[first : first + len(sizes)], sizes))
        for order in these:
            grams, mark = np.concatenate([g[order - 1] for g in found]), np.concatenate(marks)
            if order == 1:
                k, c = _packed(grams, mark.astype(np.int64))
                rows += [(group, j, k[x:y].tobytes(), _numbers(c[x:y])) for j, x, y in _cut(k, words)]
            else:
                k, c = _counted(grams, mark)
                rows += [(group, words + (order - 2) * segments + j, _short(k[x:y]), _numbers(c[x:y])) for j, x, y in _cut(k, segments)]
        return _table(rows, ["group", "bucket", "keys", "counts"])

    passes = []
    for these in [list(range(1, min(orders, 2) + 1)), *([x] for x in range(3, orders + 1))]:
        counted = grouped.groupBy("group").applyInArrow(counter(these), SENT)
        if groups > fan:
            counted = written(counted, "counted")
        passes.append(written(_totals(counted, groups, words, bits and max(64, bits // segments // 8 * 8), fan), "counts"))
        if groups > fan:
            remove(counted)
    n, v = passes[0].groupBy("bucket").agg(F.max("n").alias("n"), F.max("v").alias("v")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def rate(t: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("bucket")
        buckets, totals = own.column("bucket").to_numpy(), own.column("totals")
        runs = [(sizes, grams) for _, sizes, grams in grams_of(t, orders)]
        sizes = np.concatenate([x for x, _ in runs])
        starts = np.cumsum(sizes) - sizes
        often = upto = whole = None
        for order in range(1, orders + 1):
            grams = np.concatenate([g[order - 1] for _, g in runs])
            k, place = np.unique(grams if order == 1 else grams << np.uint64(1), return_inverse=True)
            first = 0 if order == 1 else words + (order - 2) * segments
            cuts = _cut(k, words if order == 1 else segments)
            rows = np.searchsorted(buckets, [first + j for j, _, _ in cuts]).tolist()
            back = np.concatenate([_read(totals[r].as_py(), y - x) for r, (_, x, y) in zip(rows, cuts, strict=True)])
            if order == 1:
                f = back[place].astype(np.float64)
                ends = float(back[np.searchsorted(k, END)])
                word = whole = (f + 1) / (n + v + 1)
                often = f
            else:
                upto = np.empty_like(often)  # how often the words before stand
                upto[1:] = often[:-1]
                upto[starts] = ends
                often = np.minimum(np.where(back > 0, 2.0 ** (back - 1), 0.0)[place], np.minimum(often, upto))
                whole = (often + PRIOR * whole) / (upto + PRIOR)
        cols = [sizes, np.add.reduceat(f > 0, starts, dtype=np.int64), np.full(len(sizes), n, np.int64), np.add.reduceat(np.log10(word), starts), np.add.reduceat(np.log10(whole), starts)]
        return pa.table([t.column("doc_id"), t.column("held_out"), *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    own = passes[0]
    for p in passes[1:]:
        own = own.unionByName(p)
    own = own.select(F.col("group").alias("into"), "bucket", "totals")
    return grouped.groupBy("group").cogroup(own.groupBy("into")).applyInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
