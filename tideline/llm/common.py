"""What the operators of this package share: tables, the shared folder, text kernels in numpy."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these bytes; bytes.split() without arguments splits on just these.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and nothing else.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

_MULT = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a temporary one; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tideline-{what}-{uuid.uuid4().hex}"


#: With it on, Spark deletes a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files: their results are tables, and nothing reads the shuffles again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: later readers don't compute it again, and a lost executor takes nothing away."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(table: DataFrame) -> None:
    """Deletes a table that written() made and no plan reads any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if "/tideline-" in folder:
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


REST = "__rest"


def set_aside(docs: DataFrame, *plain: str) -> DataFrame:
    """docs as the columns `plain` and one struct of all others, so that no name of theirs can clash with an operator's."""
    rest = [c for c in docs.columns if c not in plain]
    return docs.select(*plain, (F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(0).alias("none"))).alias(REST))


def brought_back(df: DataFrame, columns: list[str], plain: tuple[str, ...], **changed: Column) -> DataFrame:
    """The columns of the docs that set_aside() took; `changed` gives other values for some."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col(c) if c in plain else F.col(REST).getField(c).alias(c) for c in columns))


def word_count(text: Column) -> Column:
    """Number of words as long, 0 for null; built-in expressions only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text modulo mod; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % mod


def slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cuts a batch into runs of documents of about `most` bytes (one longer text makes a run of its own): (first index, UTF-8 texts); null is empty."""
    run: list[bytes] = []
    first = held = 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if run and held + len(b) > most:
            yield first, run
            run, first, held = [], i, 0
        run.append(b)
        held += len(b)
    if run:
        yield first, run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public murmur constants); wraps around."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_BASE, _INV = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


#: Bytes of text, or words, that the kernels below hash at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _long_word(word: bytes) -> int:
    """What hash_words() sums up for one word, a piece at a time."""
    total, scale, step = 0, 1, pow(_BASE, PIECE, 1 << 64)
    p = powers(min(PIECE, len(word)), _BASE)
    for at in range(0, len(word), PIECE):
        b = np.frombuffer(word, np.uint8, min(PIECE, len(word) - at), at).astype(np.uint64) + np.uint64(1)
        total = (total + scale * int((b * p[: len(b)]).sum(dtype=np.uint64))) & (2**64 - 1)
        scale = scale * step & (2**64 - 1)
    return total


def _piece_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and length of each word of some bytes."""
    buf = np.frombuffer(data, np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) == 1 and ends[0] - starts[0] > PIECE:
        sums = np.array([_long_word(data[starts[0] : ends[0]])], np.uint64)
    else:
        h = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf), _BASE), out=h[1:])
        sums = (h[ends] - h[starts]) * powers(len(buf) + 1, _INV)[starts]
    return mix(sums ^ ((ends - starts).astype(np.uint64) * _MULT)), starts, ends - starts


def hash_words(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a run of texts in order, and the number of words of each text.

    Polynomial prefix sums over the bytes: no Python object for any word. A word's hash depends on its bytes alone, so
    texts are hashed in pieces of about PIECE bytes, cut at white space: what is held beside the hashes doesn't grow with a text.
    """
    data = run[0] if len(run) == 1 else b"\n".join(run)
    ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1)
    found, of, at = [], np.zeros(len(run), np.int64), 0
    while at < len(data):
        upto = len(data)
        if upto - at > PIECE:
            if (back := max(data.rfind(c, at, at + PIECE) for c in b" \n\t\r\v\f")) > at:
                upto = back
            elif data[at : at + 1].isspace():
                upto = at + 1
            elif cut := _SPACE.search(data, at + PIECE):
                upto = cut.start()
        words, starts, _ = _piece_words(data[at:upto])
        found.append(words)
        of += np.bincount(np.searchsorted(ends, starts + at, side="right"), minlength=len(run))
        at = upto
    return np.concatenate(found) if found else np.zeros(0, np.uint64), of


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words (len(words) - n + 1 of them), PIECE at a time."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for at in range(0, len(out), PIECE):
        some = words[at : at + PIECE + n - 1]
        h = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * powers(len(some), _BASE), out=h[1:])
        out[at : at + PIECE] = mix((h[n:] - h[:-n]) * powers(len(some) - n + 1, _INV))
    return out


def batches(it: Iterable, names: list[str]) -> Iterator[list[list]]:
    """Columns of Arrow batches as Python lists."""
    for b in it:
        yield [b.column(n).to_pylist() for n in names]
