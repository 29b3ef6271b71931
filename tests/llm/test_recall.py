"""Recall of the neighbour search at 10,000 vectors against brute force, for data that are hard on a graph."""

import numpy as np
import pytest

from tideline.llm import common, jaccard, neighbours


def gaussian(rng, d):
    return rng.normal(size=(10_000, d))


def unit(rng, d):
    x = gaussian(rng, d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def one_long(rng, d):
    x = gaussian(rng, d)
    x[77] *= 1e6
    return x


def huge(rng, d):
    return gaussian(rng, d) * 1e20


def spread(rng, d):
    return unit(rng, d) * 10.0 ** rng.uniform(-6, 6, (10_000, 1))


def clustered(rng, d):
    return rng.normal(size=(60, d))[rng.integers(0, 60, 10_000)] + 0.3 * gaussian(rng, d)


def recall(spark, x, shard_rows):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).cache()
    got: dict = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 50 = 0"), shard_rows=shard_rows).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[r["vec_id"]] @ x[r["query_id"]]), rel=1e-9)
    hits = 0
    for q in range(0, len(x), 50):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & set(got[q]))
    return hits / (20 * len(got))


@pytest.mark.parametrize("make", [one_long, huge, spread, clustered])
def test_recall(spark, make):
    assert recall(spark, make(np.random.default_rng(8), 24), 2500) >= 0.95


@pytest.mark.parametrize("make, d, n", [(gaussian, 64, 10_000), (unit, 256, 4000)])
def test_recall_of_one_shard(make, d, n):
    """A graph alone, searched with the usual width."""
    x = make(np.random.default_rng(8), d)[:n]
    x /= np.linalg.norm(x, axis=1).max()
    found = neighbours.Graph(x.astype(np.float32)).search(x[:100].astype(np.float32))
    true = np.argsort(-(x[:100] @ x.T), axis=1)[:, :20]
    assert np.mean([np.isin(t, f).mean() for t, f in zip(true, found, strict=True)]) >= 0.95


def test_queries_go_to_few_cells():
    """Where vectors lie in clusters, the true neighbours of a query are in the few cells that promise most."""
    x = clustered(np.random.default_rng(3), 32)
    cells = neighbours.Cells(np.zeros(40, np.int64), neighbours.fit_pivots(neighbours.directions(x), 40))
    cell = cells.cell(x, np.zeros(len(x), np.int64))
    place = np.argsort(cells.ranked(x[:100]), axis=1)
    true = np.argsort(-(x[:100] @ x.T), axis=1)[:, :20]
    assert (np.take_along_axis(place, cell[true], 1) < 8).mean() > 0.97


def test_near_dedup_proposes_by_simhash_and_balls():
    """Fingerprints are majorities of the shingles' hashes; their balls meet just where they differ in 4 bits at most, and pairs at 0.8 meet in some table."""
    rng = np.random.default_rng(4)
    width, number = jaccard.tables(1000)
    words = max(jaccard.FURTHER, -(-width * number // 64))
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 2, 3, 254, 255, 256, 600)]
    salts = common.mix(np.arange(1, 2 * words + 1, dtype=np.uint64)).reshape(-1, 2)
    for grams, got in zip(sets, jaccard.prints(sets, words), strict=True):
        bits = np.unpackbits(np.array([common.mix((grams ^ a) * (b | np.uint64(1))) for a, b in salts]).T.copy().view(np.uint8), axis=1).astype(int)
        assert np.unpackbits(got.view(np.uint8)).tolist() == [int(2 * x > len(grams) or (2 * x == len(grams) and f)) for x, f in zip(bits.sum(axis=0), bits[0], strict=True)]

    for shared, one, other in ((4, 0, 1), (8, 1, 1), (80, 10, 10), (800, 0, 200)):
        a, b = [], []
        for _ in range(150):
            grams = rng.integers(0, 2**64, shared + one + other, dtype=np.uint64)
            a.append(np.unique(grams[: shared + one]))
            b.append(np.unique(np.concatenate((grams[:shared], grams[shared + one :]))))
        held = np.zeros(300, jaccard._RECORD)
        held["key"], held["root"], n = np.arange(300), np.arange(300), np.array(list(map(len, a + b)), np.uint64)
        together, all_prints = set(), jaccard.prints(a + b, words)
        for k in range(number):
            fps, held["check"] = jaccard._table(all_prints, width, k)
            held["print"] = fps | n
            found = set()
            for bucket in range(16):
                near = np.bitwise_count((fps >> np.uint64(60)) ^ np.uint64(bucket)) <= 2
                found |= {(int(u), int(v)) for u, v, _ in zip(*jaccard.meet(held[near], width, 4, bucket), strict=True)}
            apart = sum(np.bitwise_count(held["check"][:, None, i] ^ held["check"][None, :, i]).astype(int) for i in range(jaccard.FURTHER))
            want = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (apart <= jaccard.APART)
            assert found == {(u, v) for u, v in zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True) if u > v}
            together |= found
        assert sum((k + 150, k) in together for k in range(150)) >= 149
