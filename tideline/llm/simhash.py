"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming distance by ball hashing.

Two fingerprints within distance 2 r share a value within r of both: the middle of a path between them. So every
distinct fingerprint stands for all its variants within r = 2 (2,081 of them at 64 bits), and fingerprints that
meet in a variant are linked. A variant is sent as its leading bits only: a fingerprint goes to each bucket that one
of its variants begins with (37 buckets at 8 bits), and the bucket's task makes the variants' other bits itself, so
that 300 bytes a fingerprint are shuffled instead of 33,000. Fingerprints that meet are verified and joined inside
the task, which passes on one edge for each that is no root there: a group of n near copies gives no n * n pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, brought_back, set_aside, written
from tideline.llm.components import components

SEED, SHINGLE, DISTANCE = 42, 4, 4
#: Variants that a task holds at once; fingerprints of a bucket beyond which it is split.
AT_ONCE, FULL = 1 << 20, 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one UTF-8 text; 0 if it has no word."""
    return int(fingerprints([text], shingle)[0])


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text (uint64): A-Z lower-cased, shingles of `shingle` words with repeats, XXH64 with seed 42."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.translate(LOWER).split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= shingle:
            out[k] = digest(line, SEED)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - shingle + 1
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 14):  # long texts a part at a time
            ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


@functools.cache
def masks(bits: int, most: int, shift: int = 0) -> list[np.ndarray]:
    """XOR masks of `bits` bits (moved up by `shift`), by the number of set bits 0..most."""
    return [np.array([sum(1 << (b + shift) for b in c) for c in combinations(range(bits), n)], np.uint64) for n in range(most + 1)]


def with_fingerprints(docs: DataFrame, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, fp (the fingerprint as a signed long) and the columns named in `carry`, of every row. A null text counts as empty."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), *carry)
    schema = picked.drop("_text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(it):
        for b in it:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column("_text")]
            rest = b.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(fingerprints(texts).view(np.int64), pa.int64())], [*rest.schema.names, "fp"])

    return picked.mapInArrow(run, schema)


def _roots(fps: np.ndarray, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> None:
    """Joins the places a[i] and b[i] of fps; a root is the smallest place of its group."""
    while len(a):
        for x in (a, b):
            while (up := parent[x]).max(initial=0) != x.max(initial=0) or (up != x).any():
                x[:] = up
        low, high = np.minimum(a, b), np.maximum(a, b)
        more = low != high
        low, high = low[more], high[more]
        if not len(low):
            return
        np.minimum.at(parent, high, low)
        a, b = low, high


def balls(fps: np.ndarray, prefix: int, bucket: int, half: int = DISTANCE // 2, width: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variant, place in fps) of all variants within `half` bits that begin with the `prefix` bits of `bucket`, in parts sorted by both.

    Fingerprints are the leading `width` bits. Variants are made by their next bits, split until a part has at most
    AT_ONCE of them: a variant has one beginning, so each bit parts them, however alike the fingerprints are. At full
    width a part has one variant for each fingerprint near one value, never more than there are fingerprints.
    """
    named = max(1, len(fps).bit_length())
    ball = {(rest, n): sum(comb(rest, k) for k in range(n + 1)) for rest in range(width - prefix + 1) for n in range(half + 1)}
    used = np.bitwise_count((fps >> np.uint64(64 - prefix)) ^ np.uint64(bucket)) if prefix else np.zeros(len(fps), np.uint8)
    near = np.flatnonzero(used <= half)
    parts = [(prefix, near, used[near])]
    while parts:
        bits, at, used = parts.pop()
        if not len(at):
            continue
        rest = width - bits
        many = sum(ball[rest, half - f] * int(n) for f, n in enumerate(np.bincount(used, minlength=half + 1)))
        if rest and (many > AT_ONCE or rest + named > 64):
            bit = (fps[at] >> np.uint64(63 - bits)).astype(np.uint8) & 1
            for x in (0, 1):
                spent = used + (bit != x)
                parts.append((bits + 1, at[spent <= half], spent[spent <= half]))
            continue
        tail = (fps[at] >> np.uint64(64 - width)) & np.uint64((1 << rest) - 1)
        tails, found = masks(rest, half), []
        for f in range(half + 1):
            some = used == f
            for m in tails[: half - f + 1]:
                found.append((((tail[some][:, None] ^ m[None, :]) << np.uint64(named)) | at[some].astype(np.uint64)[:, None]).ravel())
        both = np.concatenate(found)
        both.sort()
        yield both >> np.uint64(named), (both & np.uint64((1 << named) - 1)).astype(np.int64)


def meet(fps: np.ndarray, prefix: int, bucket: int, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) between fingerprints of which some variant begins with the `prefix` bits of `bucket`.

    Fingerprints that share a variant are tied to the first of them, after their distance is verified.
    """
    fps = np.unique(fps)
    parent = np.arange(len(fps))
    for key, at in balls(fps, prefix, bucket, distance // 2):
        same = np.flatnonzero(key[1:] == key[:-1])
        if not len(same):
            continue
        first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0))
        pair = np.unique(at[first[same + 1]] * len(fps) + at[same + 1])
        a, b = pair // len(fps), pair % len(fps)
        true = (np.bitwise_count(fps[a] ^ fps[b]) <= distance) & (a != b)
        _roots(fps, a[true], b[true], parent)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[child], fps[parent[child]]


def _sent(fps: np.ndarray, prefix: int, within: tuple[int, int] | None, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place in fps) of every bucket of `prefix` bits in which some variant of a fingerprint begins; `within` keeps the buckets below a shorter one (bits, bucket)."""
    if within is None:
        heads = np.concatenate(masks(prefix, half))
        return ((fps >> np.uint64(64 - prefix))[:, None] ^ heads[None, :]).ravel(), np.repeat(np.arange(len(fps)), len(heads))
    short, bucket = within
    used = np.bitwise_count((fps >> np.uint64(64 - short)) ^ np.uint64(bucket)).astype(np.int64)
    more = np.uint64((1 << (prefix - short)) - 1)
    to, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for f in range(half + 1):
        at = np.flatnonzero(used == f)
        tails = np.concatenate(masks(prefix - short, half - f))
        to.append((np.uint64(bucket << (prefix - short)) | ((fps[at] >> np.uint64(64 - prefix)) & more)[:, None] ^ tails[None, :]).ravel())
        who.append(np.repeat(at, len(tails)))
    return np.concatenate(to), np.concatenate(who)


def links(fps: DataFrame, prefix: int | None = None, distance: int = DISTANCE, full: int = FULL) -> DataFrame:
    """Edges (u, v) that connect just the fingerprints (column fp, distinct longs) that chains of links connect.

    The prefix grows with the number of fingerprints, so that a bucket holds some tens or hundreds of thousands of them,
    whatever their number. A bucket that gets more than `full` (families of near copies begin alike) is split by its next bits.
    """
    half = distance // 2
    if prefix is None:
        prefix = int(max(8, np.ceil(np.log2(max(1, fps.count()) / 1e6) + 8)))

    def packed(to, what):
        order = np.argsort(to, kind="stable")
        to = to[order]
        cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, int)
        return to[cuts], [what[order[x:y]] for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(to)).tolist(), strict=True)]

    def count(it):
        for b in it:
            to, who = _sent(b.column("fp").to_numpy().view(np.uint64), prefix, None, half)
            which, n = np.unique(to, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(which.view(np.int64)), pa.array(n, pa.int64())], ["bucket", "n"])

    sizes = fps.select("fp").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > full)
    # at most (fingerprints * buckets of one / full) rows
    crowded = {r["bucket"]: min(64 - half, prefix + int(np.ceil(np.log2(r["n"] / full))) + 4) for r in sizes.collect()}

    def send(it):
        for b in it:
            f = b.column("fp").to_numpy().view(np.uint64)
            to, held = packed(*(lambda to, who: (to, f[who]))(*_sent(f, prefix, None, half)))
            rows = []
            for bucket, some in zip(to.tolist(), held, strict=True):
                if bucket in crowded:
                    inner, who = _sent(some, crowded[bucket], (prefix, bucket), half)
                    rows += [(crowded[bucket], x, y.tobytes()) for x, y in zip(*(lambda a, c: (a.tolist(), c))(*packed(inner, some[who])), strict=True)]
                else:
                    rows.append((prefix, bucket, some.tobytes()))
            n, x, y = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(np.array(x, np.uint64).view(np.int64)), pa.array(y, pa.binary())], ["bits", "bucket", "fps"])

    def join(t: pa.Table) -> pa.Table:
        held = np.frombuffer(b"".join(t.column("fps").to_pylist()), np.uint64)
        u, v = meet(held, t.column("bits")[0].as_py(), t.column("bucket")[0].as_py() & (2**64 - 1), distance)
        return pa.table({"u": pa.array(u.view(np.int64), pa.int64()), "v": pa.array(v.view(np.int64), pa.int64())})

    return fps.select("fp").mapInArrow(send, "bits int, bucket long, fps binary").groupBy("bits", "bucket").applyInArrow(join, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, carry: list[str] = [], distance: int = DISTANCE) -> DataFrame:  # noqa: B006
    """doc_id, fp and component_id of every row, and the columns named in `carry`.

    component_id is the smallest doc_id among the rows that chains of links reach, itself included. Rows of equal
    fingerprint are linked; texts without a word have fingerprint 0 and are linked like any other. A null doc_id takes
    part, but is never the smallest (a component of null ids alone has component_id null). Repeated rows stay.
    """
    held = written(with_fingerprints(docs, carry), "fingerprints")
    distinct = written(held.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = written(components(links(distinct, distance=distance)), "roots")
    tied = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    named = tied.select("fp", "root").join(least, "root").select("fp", "component_id")
    return held.join(named, "fp").select("doc_id", "fp", "component_id", *carry)


def fingerprint_text(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def kept(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays, once.

    Of several rows with that doc_id one of the smallest text hash stays; of rows that are wholly equal, one. A
    component of null ids alone keeps one row. Only ids and hashes are compared: texts are read again at the end. Other
    columns are set aside, whatever their names.
    """
    plain = ("doc_id", "text")
    keyed = set_aside(docs, *plain).withColumn("key", F.xxhash64("text"))
    found = near_duplicates(keyed.select("doc_id", "text", "key"), ["key"], distance).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(F.min("key").alias("k")).select(F.col("component_id").alias("id"), "k")
    back = keyed.join(one, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))
    return brought_back(back.dropDuplicates(["doc_id", "key"]), docs.columns, plain)
