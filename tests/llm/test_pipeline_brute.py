"""The pipeline's rows against a plain version of every stage."""

import hashlib
import random

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from test_text_operators import brute_removed, sha

from tideline.llm import bpe, mixing, quality


def prose(rng, vocabulary, n):
    return " ".join(rng.choices(vocabulary, k=n))


def corpus():
    """Good and bad texts, exact and near copies, shared passages, odd rows; and labels of most."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    rows = [(i, prose(rng, vocabulary, rng.randint(20, 120)).capitalize() + ".") for i in range(160)]
    shared = prose(rng, vocabulary, 70)
    rows += [(200 + k, rows[k][1]) for k in range(6)]
    rows += [(220 + k, rows[20 + k][1] + f" tail{k}") for k in range(6)]
    rows += [(240 + k, f"{prose(rng, vocabulary, 30)} {shared}  {prose(rng, vocabulary, 15)}") for k in range(5)]
    rows += [(260, "Été, x² — 日本語 \U0001f600 " + prose(rng, vocabulary, 40)), (261, None), (262, ""), (None, prose(rng, vocabulary, 50))]
    bad = [(300 + k, " ".join(f"{w.upper()}!!" for w in rng.choices(vocabulary, k=60))) for k in range(40)]
    rows = [(i, t, "en", ("s0", "s1", "s2", None)[k % 4 if k % 3 else 0], None if t is None else len(t)) for k, (i, t) in enumerate(rows + bad)]
    return rows, [(i, int(i < 300), 0) for i, *_ in rows if i is not None and i % 7]


def is_good(docs, labels):
    """The classifier fitted on the same rows, without Spark: which texts it keeps."""
    from zlib import crc32

    learn = lambda i: crc32(str(i).encode()) % 3 != 1
    known = {i: q for i, q, _ in labels if learn(i)}
    texts = {i: (t or "").encode() for i, t, *_ in docs if i is not None and t is not None}
    p, u = sorted(i for i, q in known.items() if q == 1 and i in texts), sorted(i for i in texts if learn(i))
    x = lambda ids: quality.features([texts[i] for i in ids]).astype(np.float16).astype(np.float32)
    model = quality.fit(x(p), x(u), float(np.mean(list(known.values()))))
    return [model.score(quality.features([(t or "").encode()]))[0] >= 0.5 for _, t, *_ in docs]


def without_near_copies(docs):
    grams = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in ((t or "").encode().lower().split() for _, t, *_ in docs)]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for k, g in enumerate(group):
        least[g] = min(least.get(g, k), k, key=lambda j: (docs[j][0] is None, docs[j][0] or 0))
    return [docs[k] for k in sorted(least.values())]


def without_passages(docs):
    out = []
    for (i, text, lang, source, n), (_, words, gone) in zip(docs, brute_removed(docs), strict=True):
        if words and all(gone):
            continue
        if any(gone):
            text = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
            n = len(text)
        out.append((i, text, lang, source, n))
    return out


def mixed(docs):
    con = duckdb.connect()
    con.register("documents", pa.table({c: pa.array([d[k] for d in docs], t) for k, (c, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())))}))
    taken = {r[0]: (r[1], r[4]) for r in con.sql(mixing.SQL).fetchall()}
    out = []
    for i, text, *_ in docs:
        size, words = taken[i]
        for part in [size, words - size] if words > size else [words]:
            if part:
                out.append((i, text if part == size else b" ".join(text.encode().split()[:part]).decode()))
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = [d for d, good in zip(rows, is_good(rows, labels), strict=True) if good]
    assert len(rows) - 45 < len(kept) < len(rows) - 30
    stages = [kept]
    for stage in (without_near_copies, without_passages):
        stages.append(stage(stages[-1]))
        assert len(stages[-1]) < len(stages[-2]) or stage is without_passages and stages[-1] != stages[-2]
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={}).encode_ordinary
    want = []
    for i, text in mixed(stages[-1]):
        ids = encode(text)
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), hashlib.sha256(text.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
