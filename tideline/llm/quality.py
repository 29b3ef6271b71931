"""A quality classifier learnt from trusted positives and unlabelled text (non-negative PU risk).

The model is linear in byte, byte-pair and word statistics of the whole text. Its risk is
prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]), minimised by Adam; where the part in max() falls
below zero, its gradient is turned round, as in the published non-negative estimator. Labels of class 0 are not
learnt from as examples; they serve to estimate the class prior only (the share of label 1 among training labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import LOWER, REST, brought_back, fold_of, hash_words, set_aside, slices

#: Rows that the fit reads at most: positives and unlabelled documents with the smallest hashes of their ids.
POSITIVES, UNLABELLED = 4000, 6000
PAIRS = 1024
STATS = 12
SIZE = 256 + PAIRS + 3 * STATS
#: Logits are held within this range.
CLIP = 30.0

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def features(texts: list[bytes]) -> np.ndarray:
    """A row of SIZE floats for each text; all 0 for an empty one."""
    out = np.zeros((len(texts), SIZE), np.float32)
    words, sizes = hash_words([t.translate(LOWER) for t in texts]) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    ends = np.cumsum(sizes)
    for k, text in enumerate(texts):
        if not text:
            continue
        b = np.frombuffer(text, np.uint8)
        single = np.bincount(b, minlength=256)
        n = len(b)
        out[k, :256] = np.sqrt(single / n)
        if n > 1:
            pair = (b[:-1].astype(np.int32) * 149 + b[1:].astype(np.int32) * 37) % PAIRS
            out[k, 256 : 256 + PAIRS] = np.sqrt(np.bincount(pair, minlength=PAIRS) / (n - 1))
        w = words[ends[k] - sizes[k] : ends[k]]
        m = max(1, len(w))
        kinds, counts = np.unique(w, return_counts=True)
        other = ~(_UPPER | _LOWER | _DIGIT | _SPACE)
        stats = (
            single[_UPPER].sum() / n, single[_LOWER].sum() / n, single[_DIGIT].sum() / n, single[_SPACE].sum() / n, single[other].sum() / n, single[10] / n,
            (w[1:] == w[:-1]).sum() / m, counts.max(initial=0) / m if len(w) > 8 else 0.0, len(kinds) / m, min(1.0, n / m / 30), np.log1p(m) / 12, single.max() / n,
        )
        x = np.array(stats, np.float32)
        out[k, 256 + PAIRS :] = np.concatenate((x, x * x, np.sqrt(x)))
    return out


class Model:
    """Weights over standardised features, and the bias."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -CLIP, CLIP)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.01, decay: float = 2e-3, seed: int = 7) -> Model:
    """Minimises the non-negative PU risk of the logistic loss. Without positives or unlabelled rows the score is the prior."""
    size = positive.shape[1]
    prior = float(min(max(prior, 0.01), 0.99))
    bias0 = float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(size, np.float32), np.ones(size, np.float32), np.zeros(size, np.float32), bias0)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.01
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (positive, unlabelled))
    w, b = np.zeros(size, np.float32), bias0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    rng = np.random.default_rng(seed)
    step = 0
    for _ in range(rounds):
        ip, iu = rng.integers(0, len(p), min(len(p), 1024)), rng.integers(0, len(u), min(len(u), 2048))
        xp, xu = p[ip], u[iu]
        sp, su = 1 / (1 + np.exp(-(xp @ w + b))), 1 / (1 + np.exp(-(xu @ w + b)))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-7)).mean()
        up, un = (-(1 - sp)) * prior / len(sp), su / len(su)
        back = -prior * sp / len(sp)
        if negative < 0:  # the estimate of the negatives' risk has gone below what is possible: climb back
            gp, gu = -back, -un
        else:
            gp, gu = up + back, un
        g = xp.T @ gp.astype(np.float32) + xu.T @ gu.astype(np.float32) + decay * w
        gb = float(gp.sum() + gu.sum())
        step += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        now = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= (now * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        b -= float(now * mb / (np.sqrt(vb) + 1e-8))
    return Model(mean.astype(np.float32), scale.astype(np.float32), w, b)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """The model for docs (doc_id, text), from labels (doc_id, quality).

    Only ids with crc32 mod 3 other than 1 are learnt from. The fit reads the `positives` rows of label 1 and the
    `unlabelled` documents with the smallest hashes of their ids: bounds that don't grow with the tables, as an id on
    several rows gives the one of the smallest text hash. Null ids, labels and texts take no part. The class prior is the
    share of label 1 among the training labels: an estimate that supposes them to be a random sample of the documents.
    """
    order = F.xxhash64("doc_id", F.lit("quality"))
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold_of(F.col("doc_id"), 3) != 1))
    prior = trusted.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    good = trusted.filter(F.col("quality") == 1).select("doc_id").distinct().orderBy(order).limit(positives).withColumn("_kind", F.lit(1))
    web = held.select("doc_id").filter(fold_of(F.col("doc_id"), 3) != 1).distinct().orderBy(order).limit(unlabelled).withColumn("_kind", F.lit(0))
    ids = good.unionByName(web)  # at most positives + unlabelled rows: small enough to broadcast

    def run(it):
        for b in it:
            for first, part in slices(b.column("text").to_pylist()):
                x = features(part)
                yield pa.RecordBatch.from_arrays([b.column("_kind")[first : first + len(part)], b.column("doc_id")[first : first + len(part)], pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["_kind", "doc_id", "x"])

    one = held.join(F.broadcast(ids), "doc_id").groupBy("_kind", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.mapInArrow(run, "_kind int, doc_id long, x binary").toArrow().sort_by([("_kind", "ascending"), ("doc_id", "ascending"), ("x", "ascending")])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, SIZE).astype(np.float32)
    kind = rows.column("_kind").to_numpy()
    return fit(x[kind == 1], x[kind == 0], 0.5 if prior is None else prior)


def score_documents(docs: DataFrame, model: Model, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, score (0 to 1) and the columns named in `carry` (which may be text), of every row; a null text counts as empty. A score depends on the text alone."""
    found = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text"))
    names = ["doc_id", *carry]
    schema = picked.select(*names).withColumn("score", F.lit(0.0)).schema

    def run(it):
        for b in it:
            scores = [found.value.score(features(part)) for _, part in slices(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*names, "score"])

    return picked.mapInArrow(run, schema)


def good_documents(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs whose score is `least` or more, with all their columns."""
    plain = ("doc_id", "text")
    scored = score_documents(set_aside(docs, *plain), model, ["text", REST]).filter(F.col("score") >= least)
    return brought_back(scored, docs.columns, plain)
