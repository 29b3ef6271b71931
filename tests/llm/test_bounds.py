"""Long texts, hot phrases and crowded buckets: what must stay linear, bounded and right."""

import hashlib
import json
import random
import resource
import struct
import time
import tracemalloc
import zipfile
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_removed, sha

from tideline.llm import bpe, common, media, order, quality, simhash, substrings

RANKS = P.path("byte_bpe_50k.tiktoken")


def peak_mb():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())


def test_words_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(1)
    runs = [["".join(rng.choice("ab \n\té") for _ in range(rng.choice([0, 1, 5, 40, 200]))).encode() for _ in range(rng.randint(1, 6))] for _ in range(60)] + [[b"", b"x" * 3000, b" " * 70 + b"y"]]
    whole = [common.hash_words(run) for run in runs]
    grams = [common.gram_hashes(w, 3) for w, _ in whole]
    for run, (_, sizes) in zip(runs, whole, strict=True):
        assert sizes.tolist() == [len(t.split()) for t in run]
    for piece in (5, 16, 64):
        monkeypatch.setattr(common, "PIECE", piece)
        for run, (w, sizes), g in zip(runs, whole, grams, strict=True):
            a, b = common.hash_words(run)
            assert (a == w).all() and (b == sizes).all() and (common.gram_hashes(a, 3) == g).all()


def test_memory_of_a_long_text():
    text, word = b"word and so " * 4_000_000, b"x" * 50_000_000
    before = peak_mb()
    w, _ = common.hash_words([text])
    common.gram_hashes(w, 5)
    assert len(common.hash_words([word])[0]) == 1
    assert peak_mb() - before < 8 * (len(text) >> 20) + 150


def test_repeated_words_take_linear_time():
    """A million times one word against a passage of a thousand of it: seconds."""
    line = b" ".join([b"so"] * 1_000_000)
    index = substrings.Index([b" ".join([b"so"] * 1000), b" ".join([b"so"] * 60 + [b"end"])], [1, 2])
    t = time.perf_counter()
    gone = index.covered(line, substrings.word_starts(line), 9)
    assert gone.all() and time.perf_counter() - t < 60


def test_mirrored_texts_with_one_header(spark):
    """200 pairs of texts that share one header: a passage is sent only where one of its windows stands."""
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    header = prose(60)
    bodies = [prose(80) for _ in range(200)]
    rows = [(k, f"{header} {b}") for k, b in enumerate(bodies)] + [(1000 + k, f"{header} {b} {k}") for k, b in enumerate(bodies)]
    got = sorted(map(tuple, substrings.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = [(i, len(w), sum(g), sha(b" ".join(x for x, y in zip(w, g, strict=True) if not y))) for i, w, g in brute_removed(rows)]
    assert got == sorted(want) and sum(x[2] for x in want) > 200 * 190


def test_long_passages_are_cut(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PASSAGE", 70)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    rows = [(1, " ".join(base)), (2, " ".join(["x", *base, "y"])), (3, " ".join(base[100:400])), (4, " ".join(base[30:90] + ["z"] + base[500:560]))]
    got = sorted(map(tuple, substrings.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert [x[2] for x in got] == [0, 700, 300, 120]


def test_crowded_buckets_are_split(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**64, dtype=np.uint64))
    fps = [base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(150)] + rng.integers(0, 2**64, 60, dtype=np.uint64).tolist()
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = brute_components(fps)
    for full in (8,):
        parent = list(range(len(fps)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in simhash.links(df, full=full).collect():
            a, b = (find(fps.index(int(np.int64(x).view(np.uint64)))) for x in (r["u"], r["v"]))
            parent[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(fps))] == roots


def test_sample_of_one_id_on_many_rows(spark, monkeypatch):
    """An id on 3,000 rows is one row of the sample."""
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).unionByName(spark.createDataFrame([(5, "other"), (6, "more")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: seen.append((len(p), len(u), prior)))
    quality.train(docs, labels, positives=1, unlabelled=2)
    assert len(seen) == 1 and seen[0][0] <= 1 and seen[0][1] <= 2


def test_remembered_chunks_are_bounded(monkeypatch):
    codec = bpe.Bpe(bpe.load_ranks(RANKS), P.PATTERN)
    long = ["".join(random.Random(k).choices("abcxyz", k=20_000)) for k in range(4)]
    found = [ids.tolist() for ids, _ in codec.encode_run(long)]
    assert not codec.known and [codec.decode(np.array(x)).decode() for x in found] == long
    monkeypatch.setattr(bpe, "REMEMBERED", 100_000)
    for k in range(30):
        list(codec.encode_run([f"word{j}" for j in range(k * 100, k * 100 + 100)]))
    assert codec.held < 200_000 and len(codec.known) < 500


def test_order_does_not_depend_on_splits(spark, docs, tmp_path):
    found = []
    for n in (1, 5):
        path = str(tmp_path / str(n))
        order.materialise(docs.repartition(n), path, RANKS, P.PATTERN, length=16, shard_bytes=1000).count()
        found.append({f.name: sha(f.read_bytes()) for f in sorted((tmp_path / str(n)).glob("shard-*.bin"))})
        assert not list((tmp_path / str(n)).glob("*.tmp"))
    assert found[0] == found[1] and len(found[0]) > 10


def test_media_by_hand(spark, docs, rows, tmp_path):
    """What stands in the archives, read with other code, and the features of it."""
    path = tmp_path / "archives"
    made = media.write_archives(docs, str(path), archive_bytes=3000)
    files = sorted(path.glob("*.zip"))
    assert made == len(files) and sorted(json.loads(x)[0] for x in (path / media.MANIFEST).read_text().splitlines()) == [f.name for f in files]
    want = []
    for file in files:
        with zipfile.ZipFile(file) as z:
            for name in z.namelist():
                data = z.read(name)
                width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
                assert (width, depth, colour) == (64, 8, 0) and data[:8] == b"\x89PNG\r\n\x1a\n"
                at = data.index(b"IDAT")
                lines = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
                want.append((len(data), hashlib.sha256(data).hexdigest(), hashlib.sha256(b"".join(lines[k * 65 + 1 : k * 65 + 65] for k in range(height))).hexdigest()))
    got = media.media_features(media.read_archives(spark, str(path), rangeBytes=700)).collect()
    assert sorted(want) == sorted((r["media_bytes"], r["media_sha256"], r["payload_sha256"]) for r in got)
    texts = {hashlib.sha256(t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))).hexdigest(): t for t in ((r[1] or "").encode() for r in rows)}
    for r in got:
        data = texts[r["payload_sha256"]]
        full = data + bytes(r["payload_bytes"] - len(data))
        mean = sum(full) / len(full)
        std = (sum((x - mean) ** 2 for x in full) / len(full)) ** 0.5
        bins = ",".join(str(sum(x // 32 == k for x in full)) for k in range(8))
        said = dict(x.split("=") for x in r["feature"].split(";"))
        assert r["n_bytes"] == len(data) and r["tail_crc32"] == zlib.crc32(full[-64:])
        assert abs(float(said["mean"]) - mean) < 1e-5 and abs(float(said["std"]) - std) < 1e-3 and said["bins"] == bins and float(said["zero"]) == pytest.approx(full.count(0) / len(full), abs=1e-6)


def test_a_member_is_read_again_from_its_offset(tmp_path, monkeypatch):
    """A file that fails twice: the reader opens it anew and goes on at the member, which then is read."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(3):
            z.writestr(f"{k:08d}_{k}.png", media.to_png(b"x" * k))
    failures, opened = [2], []
    read = media.read_member

    def flaky(file, offset, size, crc):
        opened.append((id(file), offset))
        if offset > 0 and failures[0]:
            failures[0] -= 1
            raise OSError("connection lost")
        return read(file, offset, size, crc)

    monkeypatch.setattr(media, "read_member", flaky)
    reader = media.ArchiveReader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["error"] for r in rows] == [None] * 3 and len({r["offset"] for r in rows}) == 3
    assert [o for _, o in opened] == [rows[0]["offset"], *[rows[1]["offset"]] * 3, rows[2]["offset"]]
    failures[0] = 5  # more than the reader's tries
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["error"] is None for r in rows] == [True, False, True] and rows[1]["media"] is None
    assert pafs.LocalFileSystem().get_file_info(str(tmp_path / "a.zip")).is_file


def test_variants_of_near_copies_are_bounded():
    """A family whose fingerprints begin alike is made into variants a part at a time, and all its links are found."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, dtype=np.uint64)
    fps = np.unique(base ^ np.packbits(rng.random((6000, 64)) < 0.04, axis=1, bitorder="little").view(np.uint64).ravel())
    head = int(base) >> 56
    tracemalloc.start()
    u, v = simhash.meet(fps, 8, head)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    near = fps[np.bitwise_count((fps >> np.uint64(56)) ^ np.uint64(head)) == 0][:400]
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    for f in near.tolist():
        for g in near[np.bitwise_count(near ^ np.uint64(f)) <= 4].tolist():
            assert root.get(f, f) == root.get(g, g)
