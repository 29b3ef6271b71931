"""Token ids in training order: fixed-stride binary shards whose slots are a keyed permutation of all sequences.

Each document's ids and an end mark are cut into sequences of LENGTH ids. Sequences are numbered through the whole
corpus by what they are, not by where they were read: documents are dealt to buckets by a hash of id and text, a task
numbers a bucket's sequences in the order of that hash, and the buckets' totals (at most BUCKETS numbers) give where
each begins. So the same rows have the same order on any cluster, and a run that is taken up again finds its shards.
A Feistel network over the next even power of two, walked until it lands below the number of sequences, maps number to
slot and back without a table. Range partitions of slots are sorted and streamed to shards; a shard is one file in which
slot s stands at (s - first) * stride, so a reader goes on from any slot by one seek.
"""

from __future__ import annotations

import hashlib
import json
import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import load_ranks
from tideline.llm.common import fresh_path, mix, remove, shuffles_deleted, slices, written

LENGTH, ROUNDS, KEY = 128, 4, 20240229
#: Bytes of a shard at most; shards of a table at least, where it has as many sequences; partitions of a wave at most.
SHARD_BYTES, LEAST_SHARDS, MOST_PARTS = 64 << 20, 64, 20_000
#: Text bytes of a bucket of documents, on average, as long as there are no more than BUCKETS of them.
BUCKET_BYTES, BUCKETS = 8 << 20, 1 << 16
#: Shards are dealt out in so many waves, each a shuffle of its share of the sequences: the disk never holds a whole shuffle beside tokens and shards.
WAVES = 4
SLOTS = "seq long, slot long, shard long, byte_offset long, doc_id long, doc_seq long, n_tokens long"


class Permutation:
    """A keyed bijection of range(n)."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n, self.half = n, np.uint64(max(1, math.ceil(math.log2(max(n, 2)) / 2)))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = [mix(np.array([(key * 2 + 1) * (r + 1) & (2**64 - 1)], np.uint64))[0] for r in range(rounds)]

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mix(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & self.mask)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._pass(np.asarray(x).astype(np.uint64), back)
        while (out_of := np.flatnonzero(out >= self.n)).size:
            out[out_of] = self._pass(out[out_of], back)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


_ENCODERS: dict[str, object] = {}


def encoder(name: str, ranks: dict[bytes, int], pattern: str):
    """The library's encoder, one per worker process and rank file."""
    if name not in _ENCODERS:
        import tiktoken

        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def token_rows(docs: DataFrame, rank_path: str, pattern: str, length: int = LENGTH) -> DataFrame:
    """bucket, start (number of the bucket's sequences before), doc_id, n (ids with the end mark) and ids (bytes, little-endian uint16 or uint32)."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_path))
    end = max(ranks.value.values()) + 1
    kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = picked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(BUCKETS, max(1, math.ceil(size / BUCKET_BYTES)))
    keyed = picked.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    # rows that agree in all of this are equal, and it doesn't matter which comes first
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket", "h", "doc_id")

    def run(it):
        now, start = -1, 0
        for b in it:
            encode = encoder(rank_path, ranks.value, pattern).encode_ordinary
            keys, of = b.column("doc_id"), b.column("bucket").to_numpy()
            for first, texts in slices(b.column("text").to_pylist()):
                ids = [np.array([*encode(t.decode("utf-8", "surrogatepass")), end], kind) for t in texts]
                counts = np.array([len(x) for x in ids], np.int64)
                starts = []
                for bucket, more in zip(of[first : first + len(ids)].tolist(), (-(-counts // length)).tolist(), strict=True):
                    if bucket != now:
                        now, start = bucket, 0
                    starts.append(start)
                    start += more
                yield pa.RecordBatch.from_arrays([b.column("bucket")[first : first + len(ids)], pa.array(starts, pa.int64()), keys[first : first + len(ids)], pa.array(counts), pa.array([x.tobytes() for x in ids], pa.binary())], ["bucket", "start", "doc_id", "n", "ids"])

    return dealt.select("bucket", "doc_id", "text").mapInArrow(run, "bucket int, start long, doc_id long, n long, ids binary")


def materialise(docs: DataFrame, path: str, rank_path: str, pattern: str, length: int = LENGTH, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards of docs (doc_id, text) and order.json to the folder `path`, and returns what a reader finds there:

    seq (number), slot, shard, byte_offset, doc_id, doc_seq (which sequence of its document, from 0), n_tokens (without
    padding) and sha256 of the stored bytes, read back from the shard. A null or empty text has one sequence, the end
    mark; the last sequence of a document is filled up with end marks. Repeated rows and null ids are rows like others.
    All shards are written when this returns; digests are taken from them when its result is read. A task that runs again writes the same shard in the other's place.
    """
    spark = docs.sparkSession
    end = max(load_ranks(rank_path).values()) + 1
    kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
    stride = length * kind.itemsize
    rows = written(token_rows(docs, rank_path, pattern, length), "tokens")
    totals = sorted((r["bucket"], r["total"]) for r in rows.groupBy("bucket").agg(F.sum(F.ceil(F.col("n") / length)).cast("long").alias("total")).collect())  # at most BUCKETS rows
    before, n = np.zeros(max((x for x, _ in totals), default=0) + 1, np.int64), 0
    for bucket, total in totals:
        before[bucket], n = n, n + total
    per_shard = max(1, min(shard_bytes // stride, math.ceil(n / LEAST_SHARDS)))
    shards = math.ceil(n / per_shard)
    fs, folder = pafs.FileSystem.from_uri(path)
    fs.create_dir(folder)
    with fs.open_output_stream(f"{folder}/order.json") as f:
        f.write(json.dumps({"sequences": n, "length": length, "dtype": kind.str, "end": end, "key": key, "rounds": ROUNDS, "per_shard": per_shard}).encode())
    offsets = spark.sparkContext.broadcast(before)

    def deal(it, wave, waves):
        order = Permutation(n, key)
        for b in it:
            counts, starts = b.column("n").to_numpy(), b.column("start").to_numpy() + offsets.value[b.column("bucket").to_numpy()]
            sequences = -(-counts // length)
            row = np.repeat(np.arange(b.num_rows), sequences)
            which = np.arange(len(row)) - np.repeat(np.cumsum(sequences) - sequences, sequences)
            seq = starts[row] + which
            slot = order.slot(seq)
            mine = np.flatnonzero(slot // per_shard % waves == wave)
            row, which, seq, slot = row[mine], which[mine], seq[mine], slot[mine]
            ids = b.column("ids")
            for at in range(0, len(row), 8192):
                x = slice(at, at + 8192)
                used, place = np.unique(row[x], return_inverse=True)
                flat = np.frombuffer(b"".join(ids.take(pa.array(used)).to_pylist()), kind)
                left = np.minimum(counts[row[x]] - which[x] * length, length)
                first = (np.cumsum(counts[used]) - counts[used])[place] + which[x] * length
                inside = np.arange(length) < left[:, None]
                full = np.full((len(left), length), end, kind)
                full[inside] = flat[(first[:, None] + np.arange(length))[inside]]
                data = full.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot[x] // per_shard), pa.array(slot[x]), pa.array(seq[x]), b.column("doc_id").take(pa.array(row[x])), pa.array(which[x]), pa.array(left), pa.array([data[y : y + stride] for y in range(0, len(data), stride)], pa.binary())],
                    ["shard", "slot", "seq", "doc_id", "doc_seq", "n_tokens", "data"],
                )

    def write(it):  # rows of a range of shards, in the order of their slots
        fs, folder = pafs.FileSystem.from_uri(path)
        task, now, out = TaskContext.get().taskAttemptId(), -1, None

        def close():
            out.close()
            fs.move(f"{folder}/shard-{now:08d}.bin.{task}.tmp", f"{folder}/shard-{now:08d}.bin")

        for b in it:
            of, data = b.column("shard").to_numpy(), b.column("data")
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if of[x] != now:
                    if out is not None:
                        close()
                    now = int(of[x])
                    out = fs.open_output_stream(f"{folder}/shard-{now:08d}.bin.{task}.tmp")
                out.write(b"".join(data.slice(x, y - x).to_pylist()))
            at = (b.column("slot").to_numpy() - of * per_shard) * stride
            yield pa.RecordBatch.from_arrays([b.column("seq"), b.column("slot"), b.column("shard"), pa.array(at), b.column("doc_id"), b.column("doc_seq"), b.column("n_tokens")], ["seq", "slot", "shard", "byte_offset", "doc_id", "doc_seq", "n_tokens"])
        if out is not None:
            close()

    def read_back(it):
        fs, folder = pafs.FileSystem.from_uri(path)
        for b in it:
            shard, at = b.column("shard").to_numpy(), b.column("byte_offset").to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else [0]
            found = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):  # rows of a shard stand together, as they were written
                first = int(at[x:y].min())
                with fs.open_input_file(f"{folder}/shard-{shard[x]:08d}.bin") as f:
                    f.seek(first)
                    stored = f.read(int(at[x:y].max()) + stride - first)
                found += [hashlib.sha256(stored[o - first : o - first + stride]).hexdigest() for o in at[x:y].tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "sha256"])

    found = fresh_path(spark, "slots")
    waves = min(WAVES, max(1, shards))
    with shuffles_deleted(spark):
        for wave in range(waves):
            dealt = rows.mapInArrow(partial(deal, wave=wave, waves=waves), "shard long, slot long, seq long, doc_id long, doc_seq long, n_tokens long, data binary")
            mine = max(1, -(-(shards - wave) // waves))  # shards of the wave, which are its numbers 0 .. mine - 1
            parts = min(mine, MOST_PARTS)
            ranges = dealt.repartitionById(parts, F.floor(F.floor(F.col("shard") / waves) * parts / mine).cast("int"))
            ranges.sortWithinPartitions("slot").mapInArrow(write, SLOTS).write.mode("append").option("compression", "zstd").parquet(found)
    remove(rows)
    return spark.read.schema(SLOTS).parquet(found).mapInArrow(read_back, f"{SLOTS}, sha256 string")


def read_slots(path: str, first: int, count: int) -> np.ndarray:
    """Sequences of the slots first .. first + count - 1 (fewer at the end), a row each: what a trainer reads on from where it stopped."""
    fs, folder = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{folder}/order.json") as f:
        how = json.loads(f.read())
    kind, length = np.dtype(how["dtype"]), how["length"]
    stride, rows = kind.itemsize * length, []
    last = min(first + count, how["sequences"])
    while first < last:
        shard, at = divmod(first, how["per_shard"])
        some = min(last - first, how["per_shard"] - at)
        with fs.open_input_file(f"{folder}/shard-{shard:08d}.bin") as f:
            f.seek(at * stride)
            rows.append(np.frombuffer(f.read(some * stride), kind).reshape(-1, length))
        first += some
    return np.concatenate(rows) if rows else np.zeros((0, length), kind)


def training_order(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """materialise() into a new folder of the shared directory."""
    return materialise(docs, fresh_path(docs.sparkSession, "order"), rank_path, pattern)
