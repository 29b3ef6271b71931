"""Operators over texts against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

from tideline.llm import bpe, common, licenses, ngrams, quality, simhash, substrings
from tideline.llm.common import LOWER

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe_pieces(library):
    codec = bpe.Bpe(bpe.load_ranks(RANKS), P.PATTERN)
    texts = ["", " ", "a" * 3000, " " * 700 + "x", "\n" * 50 + "x", "ñ" * 600 + "abc", "日本語テキスト" * 100, "0123456789" * 60, "it's we'll I'D", "a\x1cb \x1c c\x85 d\xa0e　 f​x \x1f", "½²三 ١٢ _a_ 'S", "\t\t x\r\n\r\n y  z "]
    for text, (ids, said) in zip(texts, codec.encode_run(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text[:20]
        assert said == " ".join(map(str, ids.tolist())) and codec.decode(ids).decode() == text


def test_bpe_round_trip(docs, none, rows, library):
    got = sorted(map(tuple, bpe.round_trip(docs, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0
    ids = bpe.encode_documents(docs.filter("doc_id = 10"), RANKS, P.PATTERN).collect()
    assert [r["ids"] for r in ids] == [library.encode_ordinary(rows[10][1])] * 2


def brute_fingerprint(text):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_meets_all_neighbours():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**64, 60, dtype=np.uint64).tolist()
    for f in fps[:40]:
        fps.append(f ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
    found, heads = [], np.concatenate(simhash.masks(8, 2))
    held = np.array(fps, np.uint64)
    to = (held >> np.uint64(56))[:, None] ^ heads[None, :]
    for bucket in range(256):
        u, v = simhash.meet(held[(to == bucket).any(axis=1)], 8, bucket)
        found += zip(u.tolist(), v.tolist(), strict=True)
    roots = brute_components(fps)
    linked = {(fps.index(u), fps.index(v)) for u, v in found}
    assert all(roots[a] == roots[b] for a, b in linked)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == roots


def test_near_duplicates(docs, none, rows):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    roots = brute_components(fps)
    least = {r: min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None) for r in set(roots)}
    want = sorted(((rows[k][0], fps[k], least[roots[k]]) for k in range(len(rows))), key=str)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_text(simhash.F.col("fp")).alias("f"), "component_id").collect()
    assert sorted(((r[0], int(r[1], 16), r[2]) for r in got), key=str) == want
    kept = simhash.kept(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(x for x in set(least.values()) if x is not None)
    assert simhash.near_duplicates(none).count() == 0 and simhash.kept(none).count() == 0


def brute_removed(rows):
    texts = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((i, w, gone))
    return out


def test_substrings(docs, none, rows):
    want = [(i, len(w), sum(g), sha(b" ".join(x for x, y in zip(w, g, strict=True) if not y))) for i, w, g in brute_removed(rows)]
    assert sum(x[2] > 0 for x in want) >= 6
    assert sorted(map(tuple, substrings.removed(docs).collect()), key=str) == sorted(want, key=str)
    left = substrings.without_repeats(docs)
    assert left.columns == docs.columns
    texts = [(i, t if not any(g) else b" ".join(x for x, y in zip(w, g, strict=True) if not y).decode()) for (i, w, g), (_, t, *_) in zip(brute_removed(rows), rows, strict=True) if not (w and all(g))]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(texts, key=str)
    assert substrings.removed(none).count() == 0 and substrings.without_repeats(none).count() == 0


def test_window_minima():
    x = np.random.default_rng(0).integers(0, 1000, 200)
    for n in (1, 2, 3, 35, 200, 201):
        assert substrings.least_of(x, n).tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]


def test_word_hashes():
    run = [b"a bb\x0bccc", b"", b" \n", b"bb a bb", "é x".encode()]
    h, sizes = common.hash_words(run)
    assert sizes.tolist() == [3, 0, 0, 3, 2] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 5
    g = common.gram_hashes(np.array([1, 2, 3, 1, 2, 3], np.uint64), 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 3


def test_ngrams(docs, none, rows):
    tokens = [(i, (t or "").encode().translate(LOWER).split() + [None]) for i, t, *_ in rows]
    held = [zlib.crc32(str("null" if i is None else i).encode()) % 7 == 2 for i, _ in tokens]
    counts = Counter(w for (_, t), h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, t), h in zip(tokens, held, strict=True))
    got = ngrams.score(docs, bits=1 << 18).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])
    assert ngrams.score(none, bits=1 << 12).count() == 0


def test_bloom_never_loses_a_level():
    keys = ngrams.mix(np.arange(3000, dtype=np.uint64))
    counts = np.arange(3000) % 40 + 1
    segments, size = 8, 1 << 13
    s = ngrams.LogBloom.segment(keys, segments)
    bits = np.stack([ngrams.LogBloom.fill(keys[s == k] & np.uint64((1 << 40) - 1), counts[s == k], size) for k in range(segments)])
    assert (ngrams.LogBloom(bits).counts(keys) >= 2.0 ** (ngrams.level(counts) - 1)).all()
    assert ngrams.level(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


def test_bloom_reads_stop_at_the_highest_level():
    full = np.full((1, 64), 255, np.uint8)
    assert set(ngrams.LogBloom(full, top=5).counts(np.arange(9, dtype=np.uint64))) == {16.0}
    assert np.isfinite(ngrams.LogBloom(full).counts(np.arange(9, dtype=np.uint64))).all()


def test_bloom_grows_with_its_pairs():
    for n in (2000, 400_000):
        keys = ngrams.mix(np.arange(2 * n, dtype=np.uint64)) & np.uint64((1 << 40) - 1)
        got = ngrams._levels([keys[:n], keys[n:]], [np.ones(n, np.int64), np.zeros(n, np.int64)], None)
        seen, unseen = (np.frombuffer(x, np.uint8) for x in got)
        assert (seen == 1).all() and (unseen > 0).mean() < 0.01


@pytest.mark.parametrize("orders, fan", [(2, 512), (4, 512), (4, 3)])
def test_ngram_scores_over_groups(docs, rows, monkeypatch, orders, fan):
    """Scores against plain counting, where counts of many groups are added up at once and in a tree."""
    monkeypatch.setattr(ngrams, "GROUP_BYTES", 4000)
    tokens = [(i, [*(t or "").encode().translate(LOWER).split(), None]) for i, t, *_ in rows]
    counts = [Counter() for _ in range(orders + 1)]
    learnt = 0
    for i, t in tokens:
        if zlib.crc32(str("null" if i is None else i).encode()) % 7 != 2:
            learnt += 1
            padded = [None] * orders + t
            for k in range(orders, len(padded)):
                for n in range(1, orders + 1):
                    counts[n][tuple(padded[k - n + 1 : k + 1])] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    quantised = lambda c: 2 ** (c.bit_length() - 1) if c else 0

    def often(padded, k, m):
        """How often the m words up to k stand, as the model knows it."""
        if k == orders - 1:
            return learnt
        here = counts[m][tuple(padded[k - m + 1 : k + 1])]
        return here if m == 1 else min(quantised(here), often(padded, k, m - 1), often(padded, k - 1, m - 1))

    want = set()
    for i, t in tokens:
        padded, total = [None] * orders + t, 0.0
        for k in range(orders, len(padded)):
            p = (often(padded, k, 1) + 1) / (n + v + 1)
            for m in range(2, orders + 1):
                p = (often(padded, k, m) + 4 * p) / (often(padded, k - 1, m - 1) + 4)
            total += math.log10(p)
        want.add((i, len(t), round(total, 6)))
    got = {(r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in ngrams.score(docs, orders=orders, fan=fan).collect()}
    assert len(got - want) <= 3 * (orders - 1)  # those with a false hit


def test_license_templates():
    a = licenses.Automaton("use [of {what:1-2} is] free {kind=now|for ever} and {rest:0-2} end")
    say = lambda text: a.find(licenses.words_of(text))
    assert say("Use free, now and end") == [(0, 5)]
    assert say("x use of this thing is free for ever and so on end y") == [(1, 12)]
    assert say("use of is free now and end") == [] and say("use free now and a b c end") == [] and say("use free and end") == []
    assert say("use use free now and end use free for ever and x end") == [(1, 5), (6, 7)]
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    for text, labels in (("Released under the MIT License.", "mit-notice"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0-notice"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-notice")):
        assert [s[0] for s in scanner.scan(text.encode())[2]] == [labels]
    assert scanner.scan("Released under some MIT License".encode())[2] == []


def test_license_scan(spark, docs, none):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[13]["n_words"], got[13]["n_base"], got[13]["first_word"], got[13]["last_word"], got[13]["base_labels"], got[13]["labels"], got[13]["score"]) == (5, 1, 3, 3, "mit", "mit,mit-notice", 1.0)
    assert got[7]["n_words"] == 0 and got[7]["first_word"] is None and got[7]["labels"] == "" and got[7]["score"] == 0.0
    rows = spark.createDataFrame([(1, "MIT license mit  LICENSE; the apache-license general public license mitlicense")], "doc_id long, text string")
    r = licenses.scan_licenses(rows).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (11, 4, 0, 7, "apache,gpl,mit", 0.5)
    assert licenses.scan_licenses(none).count() == 0


def test_quality_held_out(spark, none):
    import random

    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def good():
        return ". ".join(" ".join(rng.choices(vocabulary, k=rng.randint(5, 14))).capitalize() for _ in range(8))

    def bad():
        return rng.choice([lambda: " ".join(f"{w.upper()}!!" for w in rng.choices(vocabulary, k=60)), lambda: " ".join([rng.choice(vocabulary)] * 80), lambda: " | ".join(rng.choices(vocabulary, k=50))])()

    texts = [(i, good() if i % 5 else bad(), int(i % 5 > 0)) for i in range(700)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(None, "x"), (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, "z") for i, _, q in texts] + [(None, 1, "z"), (3, None, "z")], "doc_id long, quality int, other string")
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, quality.train(docs, labels)).collect()}
    assert len(scores) == 703 and all(0 <= s <= 1 for s in scores.values()) and scores[9000] == scores[9001]
    out = [(scores[i] >= 0.5) == (q == 1) for i, _, q in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(out) / len(out) > 0.95
    model = quality.train(none, labels.limit(0))
    assert quality.score_documents(none, model).count() == 0 and quality.good_documents(none, model).columns == none.columns
