"""Substring dedup: passages of 50 and more words that stood in a document with a smaller id are removed.

1. Every window of 50 words has an anchor: the least hash of its 16-word grams. Equal windows have equal anchors, and
   a text has only some 6 anchors per 100 words, so anchors of all documents can be counted; those of one document
   alone are dropped. Exact copies of a text are settled by its digest and send nothing further.
2. Windows with a recurring anchor are counted by their own hash: the smallest id holding a window owns it. An owner's
   windows that recur make passages, which are cut from its text, in pieces of at most PASSAGE words.
3. A passage is sent to the groups of documents that hold one of its windows. Each group compiles its passages' seeds
   (12 words in every 39, so that each window holds one) into an Aho-Corasick automaton and streams its documents
   through. A window around a hit is looked up by its hash, once, and compared to the passage byte by byte. So hashes
   only propose, what is removed has been read, and the time is linear in the text however often a phrase recurs.
"""

from __future__ import annotations

import hashlib
import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import REST, brought_back, gram_hashes, hash_words, remove, set_aside, slices, written

WINDOW, GRAM, SEED = 50, 16, 12
STRIDE = WINDOW - SEED + 1
#: Text bytes of a group of documents, on average; words of a passage at most.
GROUP_BYTES, PASSAGE = 4 << 20, 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    if len(x) < n:
        return x[:0]
    size, out = 1, x
    while size * 2 <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - size : len(x) - size + 1])


def anchored_windows(run: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text of a run; and of all its windows, in their order: anchor, text (index in the run), and hash."""
    words, sizes = hash_words(run)
    anchors = least_of(gram_hashes(words, GRAM), WINDOW - GRAM + 1)
    of = np.repeat(np.arange(len(run), dtype=np.int32), sizes)
    inside = of[: len(anchors)] == of[WINDOW - 1 :][: len(anchors)] if len(anchors) else np.zeros(0, bool)
    return sizes, anchors[inside], of[: len(anchors)][inside], gram_hashes(words, WINDOW)[inside]


def line_of(text: Column) -> Column:
    """The words of a text joined by one blank, by built-in functions."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))


def _summaries(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, sha (of the words), key (a hash of them) and anchors (those of the text, as bytes) of every row."""

    def run(it):
        for b in it:
            ids = b.column("doc_id")
            for first, part in slices(b.column("text").to_pylist()):
                lines = [_BLANKS.sub(b" ", t).strip(b" ") for t in part]
                sizes, anchors, of, _ = anchored_windows(lines)
                fresh = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (of[1:] != of[:-1]))) if len(of) else np.zeros(0, bool)
                anchors, of = anchors[fresh], of[fresh]
                cuts = np.searchsorted(of, np.arange(len(part) + 1))
                packed = [np.unique(anchors[x:y]).tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                keys = np.array([xxhash.xxh64_intdigest(x, 42) for x in lines], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids[first : first + len(part)], pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in lines], pa.string()), pa.array(keys, pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "n_words", "sha", "key", "anchors"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, sha string, key long, anchors binary")


def _exploded(df: DataFrame, keys: list[str], packed: str) -> DataFrame:
    """(keys, a) with a row for each value packed in a column of bytes."""

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                blobs = part.column(packed).to_pylist()
                take = pa.array(np.repeat(np.arange(len(blobs)), [len(x) // 8 for x in blobs]))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in keys), pa.array(np.frombuffer(b"".join(blobs), np.int64), pa.int64())], [*keys, "a"])

    kinds = dict(df.dtypes)
    return df.select(*keys, packed).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", a long")


def _windows(affected: DataFrame) -> DataFrame:
    """(w, a, doc_id, group): hashes of the windows whose anchor recurs, and the anchor's lower half."""

    def run(it):
        for b in it:
            ids, groups, shared = b.column("doc_id").to_numpy(), b.column("group").to_numpy(), b.column("shared").to_pylist()
            for first, part in slices(b.column("line").to_pylist()):
                _, anchors, of, w = anchored_windows(part)
                good = np.zeros(len(anchors), bool)
                cuts = np.searchsorted(of, np.arange(len(part) + 1))
                for k in range(len(part)):
                    good[cuts[k] : cuts[k + 1]] = np.isin(anchors[cuts[k] : cuts[k + 1]], np.array(shared[first + k], np.int64).view(np.uint64))
                of, w, a = first + of[good], w[good], anchors[good].astype(np.uint32).view(np.int32)
                for at in range(0, len(w), 1 << 16):
                    x = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(w[x].view(np.int64)), pa.array(a[x]), pa.array(ids[of[x]]), pa.array(groups[of[x]])], ["w", "a", "doc_id", "group"])

    return affected.select("doc_id", "group", "line", "shared").mapInArrow(run, "w long, a int, doc_id long, group long")


def word_starts(line: bytes) -> np.ndarray:
    """The first byte of each word of a line (words joined by one blank), and where one more would begin."""
    if not line:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(np.frombuffer(line, np.uint8) == 32) + 1, [len(line) + 1]))


def _passages(owners: DataFrame) -> DataFrame:
    """owner, passage (its words), pid (a hash of both) and anchors (lower halves) of each longest run of owned windows, cut to PASSAGE words."""

    def run(it):
        for b in it:
            rows = []
            owned = b.column("owned").to_pylist()
            ids = b.column("doc_id").to_pylist()
            for first, part in slices(b.column("line").to_pylist()):
                _, anchors, of, w = anchored_windows(part)
                cuts = np.searchsorted(of, np.arange(len(part) + 1))
                for k, text in enumerate(part):
                    mine = np.isin(w[cuts[k] : cuts[k + 1]], np.array(owned[first + k], np.int64).view(np.uint64))
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0]))))
                    starts = word_starts(text)
                    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        for u in range(x, y, PASSAGE - WINDOW + 1):
                            v = min(y, u + PASSAGE - WINDOW + 1)
                            line = text[starts[u] : starts[v + WINDOW - 1] - 1]
                            pid = xxhash.xxh64_intdigest(line, ids[first + k] & (2**64 - 1))
                            rows.append((ids[first + k], line, np.uint64(pid).view(np.int64).item(), np.unique(anchors[cuts[k] + u : cuts[k] + v].astype(np.uint32)).view(np.int32)))
            o, line, p, a = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(line, pa.binary()), pa.array(p, pa.int64()), pa.array(a, pa.list_(pa.int32()))], ["owner", "passage", "pid", "anchors"])

    return owners.select("doc_id", "line", "owned").mapInArrow(run, "owner long, passage binary, pid long, anchors array<int>").dropDuplicates(["pid", "owner"])


class Index:
    """A group's passages: the automaton of their seeds, and where each of their windows stands."""

    def __init__(self, passages: list[bytes], owners: list[int]):
        self.passages, self.starts = passages, [word_starts(p) for p in passages]
        self.automaton = ahocorasick.Automaton()
        hashes, which, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (p, starts) in enumerate(zip(passages, self.starts, strict=True)):
            for o in range(0, len(starts) - SEED, STRIDE):
                seed = f" {p[starts[o] : starts[o + SEED] - 1].decode('latin-1')} "
                self.automaton.add_word(seed, len(seed))
            w = gram_hashes(hash_words([p])[0], WINDOW)
            hashes.append(w)
            which.append(np.full(len(w), k))
            places.append(np.arange(len(w)))
        if passages:
            self.automaton.make_automaton()
        h, k, j = map(np.concatenate, (hashes, which, places))
        who = np.array(owners, np.int64)[k] if len(k) else k
        order = np.lexsort((j, who, h))
        one = order[np.concatenate(([True], h[order][1:] != h[order][:-1]))] if len(order) else order
        self.hashes, self.which, self.places, self.owner = h[one], k[one], j[one], who[one]

    def near_hits(self, line: bytes, starts: np.ndarray, windows: int) -> np.ndarray:
        """The windows of a text that hold a seed, in order."""
        found = np.fromiter((end - n + 1 for end, n in self.automaton.iter(f" {line.decode('latin-1')} ")), np.int64)
        at = np.searchsorted(starts, found)
        more = np.zeros(windows + 1, np.int64)
        np.add.at(more, np.minimum(np.maximum(at - (WINDOW - SEED), 0), windows), 1)
        np.add.at(more, np.minimum(at + 1, windows), -1)
        return np.flatnonzero(np.cumsum(more[:-1]) > 0)

    def covered(self, line: bytes, starts: np.ndarray, doc_id: int) -> np.ndarray:
        """Which words of a text stand in a window that a passage of a smaller owner holds."""
        n = len(starts) - 1
        gone = np.zeros(n + 1, np.int64)
        if n < WINDOW or not len(self.hashes):
            return gone[:n] > 0
        at = self.near_hits(line, starts, n - WINDOW + 1)
        if len(at):
            w = gram_hashes(hash_words([line])[0], WINDOW)[at]
            x = np.minimum(np.searchsorted(self.hashes, w), len(self.hashes) - 1)
            true = (self.hashes[x] == w) & (self.owner[x] < doc_id)
            at, x = at[true], x[true]
        if not len(at):
            return gone[:n] > 0
        k, j = self.which[x], self.places[x]
        fresh = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(j) != 1) | (np.diff(k) != 0)))
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(at)) - 1
        todo = list(zip(at[first].tolist(), k[first].tolist(), j[first].tolist(), (last - first + 1).tolist(), strict=True))
        while todo:  # runs of windows that a passage holds one after the other are compared as one stretch
            a, p, o, m = todo.pop()
            own = self.starts[p]
            if line[starts[a] : starts[a + m + WINDOW - 1] - 1] == self.passages[p][own[o] : own[o + m + WINDOW - 1] - 1]:
                gone[a] += 1
                gone[a + m + WINDOW - 1] -= 1
            elif m > 1:
                todo += [(a, p, o, m // 2), (a + m // 2, p, o + m // 2, m - m // 2)]
        return np.cumsum(gone[:n]) > 0


def _locate(docs: pa.Table, routed: pa.Table) -> pa.Table:
    index, rows = Index(routed.column("passage").to_pylist(), routed.column("owner").to_pylist()), []
    for doc_id, key, text in zip(docs.column("doc_id").to_pylist(), docs.column("key").to_pylist(), docs.column("line"), strict=True):
        line = text.as_buffer().to_pybytes()
        starts = word_starts(line)
        gone = index.covered(line, starts, doc_id)
        if gone.any():
            left = np.frombuffer(line + b" ", np.uint8)[np.repeat(~gone, np.diff(starts))].tobytes()[:-1]
            rows.append((doc_id, key, int(gone.sum()), hashlib.sha256(left).hexdigest(), left))
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "key", "n_removed", "kept_sha256", "kept"])


def _search(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries of all rows; the first id of each text of 50 or more words; and what texts that are no copies lose, by (doc_id, key)."""
    rows = written(_summaries(docs), "summaries")
    firsts = written(rows.filter((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("anchors").alias("anchors")), "firsts")
    occur = _exploded(firsts, ["doc_id", "key"], "anchors")
    again = occur.groupBy("a").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("a")
    shared = written(occur.join(again, "a").groupBy("doc_id", "key").agg(F.collect_list("a").alias("shared")), "shared")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0] * 8  # bytes, about
    group = F.pmod(F.xxhash64("doc_id", "key"), F.lit(max(1, math.ceil(size / GROUP_BYTES)))).alias("group")
    lines = texts.join(shared, "doc_id").withColumn("line", line_of(F.col("text"))).filter(F.xxhash64("line") == F.col("key")).select("doc_id", "key", "line", "shared", group)
    affected = written(lines.dropDuplicates(["doc_id", "key"]), "affected")
    remove(shared)
    windows = _windows(affected)
    owned = written(windows.groupBy("w").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("high")).filter("owner < high").select("w", "owner"), "owned")
    mine = owned.groupBy("owner").agg(F.collect_list("w").alias("owned")).withColumnRenamed("owner", "doc_id")
    passages = written(_passages(affected.join(mine, "doc_id")), "passages")
    # which groups hold a window that an earlier document owns: a row for each such window and group, however common its words are
    hits = windows.join(owned, "w").filter("doc_id > owner").select("group", "owner", "a").distinct()
    routes = passages.select("pid", "owner", F.explode("anchors").alias("a")).join(hits, ["owner", "a"]).select("group", "pid", "owner").distinct()
    routed = written(passages.join(routes, ["pid", "owner"]).select(F.col("group").alias("into"), "owner", "passage"), "routed")
    remove(owned)
    remove(passages)
    found = affected.select("group", "doc_id", "key", "line").groupBy("group").cogroup(routed.groupBy("into")).applyInArrow(_locate, "doc_id long, key long, n_removed long, kept_sha256 string, kept binary")
    return rows, firsts.select("sha", F.col("doc_id").alias("first")), found


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    Words are judged on the input: a word goes if a window of 50 words that covers it also starts in a row with a
    smaller doc_id. Null and empty texts have no words. Rows with a null doc_id are neither first nor later: they
    lose nothing and take nothing. Rows with the same doc_id don't count as earlier than each other.
    """
    rows, firsts, found = _search(docs)
    found = written(found.drop("kept"), "removed")
    every = rows.drop("anchors").join(firsts, "sha", "left").join(found, ["doc_id", "key"], "left")
    copy = F.col("doc_id") > F.col("first")
    return every.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages taken out of the texts; the columns stay.

    A text that loses nothing stays as it is; one that loses words is what is left, joined by one blank. Rows that
    lose all their words go. n_chars is counted anew. Other columns are set aside, whatever their names.
    """
    _, firsts, found = _search(docs)
    found = written(found.select(F.col("doc_id").alias("id"), "key", F.col("kept").cast("string").alias("kept")), "kept")
    plain = ("doc_id", "text")
    line = line_of(F.col("text"))
    keyed = set_aside(docs, *plain).withColumns({"k": F.xxhash64(line), "sha": F.sha2(line, 256)})
    joined = keyed.join(firsts, "sha", "left").join(found, (F.col("doc_id") == F.col("id")) & (F.col("k") == F.col("key")), "left")
    joined = joined.filter(~F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & ~F.coalesce(F.col("kept") == "", F.lit(False)))
    changed = {"text": F.coalesce("kept", "text")}
    if "n_chars" in docs.columns:
        n_chars = F.col(REST).getField("n_chars")
        changed["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(n_chars)
    return brought_back(joined, docs.columns, plain, **changed)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hits),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS line FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id)
"""
