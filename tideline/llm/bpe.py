"""Byte-level BPE encoding and decoding with a given rank file.

Pieces (matches of the split pattern) are put in padded numpy matrices by length. In each round every row
merges its leftmost pair of minimum rank: ranks come from a hashed pair table, the merged cell is written and
the row's tail is compacted by one cell; rows without a pair left leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import batches, slices

NONE = np.int32(np.iinfo(np.int32).max)
#: Pieces of more bytes than this merge one at a time with a heap: a row of n cells takes up to n rounds of n cells.
LONG_PIECE = 512
#: Chunks of at most SHORT characters are remembered with their ids, in some REMEMBERED bytes of a worker at most.
SHORT, REMEMBERED = 64, 64 << 20
#: White space as Unicode defines it, and the cut of a text into chunks: an optional blank with what follows up to the
#: next white space, or white space. No piece reaches over a chunk's end, so equal chunks have equal ids.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class PairTable:
    """(left id, right id) -> merged id (its rank), with open addressing in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        at, self.probes = self._slot(keys), 0
        while len(keys):  # each round puts one key in every free slot that is asked for; the rest move on
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; NONE where the pair is none (a negative id pads)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        flat, k = out.ravel(), keys.ravel()[todo]
        at = self._slot(k)
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == k
            flat[todo[hit]] = self.values[at[hit]]
            more = ~hit & (held != -1)
            if not more.any():
                break
            todo, k, at = todo[more], k[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(keys.shape)


class Bpe:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        self.whole = {token: np.int32(rank).tobytes() for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.said: dict[str, str] = {}
        self.held = 0  # bytes of the two, about

    def _matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (int32, as bytes) of pieces of similar length."""
        n, width = len(pieces), max(map(len, pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        cells = np.full((n, width), -1, np.int32)
        cells[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        final = np.full((n, width), -1, np.int32)
        row = np.arange(n)
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.pairs.ranks_of(cells[:, :-1], cells[:, 1:])
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                final[row[done], : cells.shape[1]] = cells[done]
                keep = ~done
                row, cells, rank, at, best = row[keep], cells[keep], rank[keep], at[keep], best[keep]
                if not len(row):
                    break
            i, width = np.arange(len(row)), cells.shape[1]
            tail = np.arange(width - 1) > at[:, None]  # compaction: what follows the merged cell moves up by one
            cells[i, at] = best
            cells = np.where(tail, cells[:, 1:], cells[:, :-1])
            rank = np.where(tail, rank[:, 1:], rank[:, :-1])
            width -= 1
            after = np.where(at + 1 < width, cells[i, np.minimum(at + 1, width - 1)], -1)
            rank[i, at] = self.pairs.ranks_of(cells[i, at], after)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.pairs.ranks_of(cells[before, at[before] - 1], cells[before, at[before]])
        held = final >= 0
        ends = np.cumsum(held.sum(axis=1)) * 4
        flat = final[held].tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _long(self, piece: bytes) -> bytes:
        """The same merges for one long piece, with a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before, part = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1)), [bytes([b]) for b in piece]
        heap = [(r, i) for i in range(len(ids) - 1) if (r := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or self.ranks.get(part[i] + part[j]) != r:
                continue
            part[i] += part[j]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (int32, as bytes) of each piece, which is one match of the pattern."""
        out = [b""] * len(pieces)
        by_length: dict[int, list[int]] = {}
        whole = self.whole.get
        for k, p in enumerate(pieces):
            if ids := whole(p):
                out[k] = ids
            elif len(p) > LONG_PIECE:
                out[k] = self._long(p)
            elif p:
                by_length.setdefault((len(p) + 1) // 2 if len(p) <= 16 else 8 + len(p).bit_length(), []).append(k)
        for members in by_length.values():
            step = max(1, (1 << 18) // max(len(pieces[k]) for k in members))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for k, ids in zip(part, self._matrix([pieces[k] for k in part]), strict=True):
                    out[k] = ids
        return out

    def encode_run(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Of each text of a run of bounded size: its ids, and the ids in decimal joined by blanks."""
        split = [CHUNK(t) for t in texts]
        if self.held > REMEMBERED:
            self.known.clear()
            self.said.clear()
            self.held = 0
        known, said, names = self.known, self.said, self.names
        fresh = [c for c in set().union(*split) if c not in known]
        pieces: list[str] = []
        sizes: list[int] = []
        for c in fresh:
            if c.isalpha() or c[:1] == " " and c[1:].isalpha():  # letters only: one piece
                pieces.append(c)
                sizes.append(1)
            else:
                pieces += (cut := self.split(c))
                sizes.append(len(cut))
        ids = iter(self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces]))
        long = []
        for c, n in zip(fresh, sizes, strict=True):
            known[c] = held = b"".join(islice(ids, n)) if n > 1 else next(ids)
            said[c] = words = " ".join(map(names.__getitem__, memoryview(held).cast("i")))
            if len(c) > SHORT:
                long.append(c)
            else:
                self.held += 4 * len(c) + len(held) + len(words) + 400
        for chunks in split:
            yield np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.int32), " ".join(map(said.__getitem__, chunks))
        for c in long:
            del known[c], said[c]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_CODECS: dict[tuple, Bpe] = {}


def codec(key: tuple, ranks: dict[bytes, int], pattern: str) -> Bpe:
    """One per worker process and rank file."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Bpe(ranks, pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every row.

    Null and empty texts have no ids. Rows with the same key stay separate rows; other columns are not read.
    The vocabulary is read on the driver and broadcast: its size is that of the rank file.
    """
    ranks, name = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_path)), (rank_path, pattern)

    def run(it):
        for keys, texts in batches(it, [key, text]):
            bpe = codec(name, ranks.value, pattern)
            for first, part in slices(texts, 1 << 19):
                ids = [x for x, _ in bpe.encode_run([b.decode("utf-8", "surrogatepass") for b in part])]
                yield pa.RecordBatch.from_arrays([pa.array(keys[first : first + len(part)], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} long, ids array<int>")


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the bytes that the ids decode to) of every row.

    Null texts count as empty: no ids, and both digests are those of the empty string. A row for each input
    row, whatever its doc_id. Works on half a megabyte of text at a time, so that neither many nor long texts fill memory.
    """
    ranks, name = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_path)), (rank_path, pattern)

    def run(it):
        for keys, texts in batches(it, ["doc_id", "text"]):
            bpe = codec(name, ranks.value, pattern)
            rows = []
            for first, part in slices(texts, 1 << 19):
                for k, (ids, decimal) in zip(keys[first : first + len(part)], bpe.encode_run([b.decode("utf-8", "surrogatepass") for b in part]), strict=True):
                    rows.append((k, len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            k, n, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
