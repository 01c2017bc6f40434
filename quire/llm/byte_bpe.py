"""Byte-level BPE by ranks: padded matrices, in which every row merges its leftmost pair of least rank each round."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, each, slices, spread, table, texts, tune
from .memo import IdMemo, chunks, sums

#: Pieces of up to so many bytes share matrices; longer ones (a rare piece, of any length) merge along a linked list, as
#: a matrix takes time in proportion to the square of its width: 16 s for a piece of 65,536 bytes, the list 0.2 s.
MATRIX_BYTES = 1024
#: Cells of a matrix.
CELLS = 1 << 18
_NONE = np.iinfo(np.int32).max
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded_sha256", pa.string())])
_made: dict[str, ByteBPE] = {}


class ByteBPE:
    """Encoder and decoder of a rank file (lines of base64 and rank); its results are those of the tiktoken library."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        lengths = np.array([len(x) for x in self.bytes_of])
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        keys, values = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int32)
        self._build(keys, values)
        self.pieces, self.memo = IdMemo(self._piece_ids), IdMemo(self._chunk_ids)
        # over these characters the standard library's module finds the same matches, several times as fast
        self.plain = re.compile("[\\t-\\r -~¡-±´-¸»¿-ɏ]*").fullmatch if pattern == public_tokenizers.PATTERN else lambda x: False
        letters, digits = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9"
        self.quick = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+")

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probes, built one probe for all keys at a time."""
        self.bits = int(np.ceil(np.log2(max(2, len(keys)) * 4)))
        self.keys, self.values = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, _NONE, np.int32)
        slot, self.probes = self._slot(keys), 1
        while len(keys):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.setdiff1d(np.arange(len(keys)), put)
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, which is also the id it merges to; _NONE where there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at != np.uint64(2**64 - 1))]
        return out

    def _matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of similar length, none of them empty: one after the other, and how many each has."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(n.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        column = np.arange(width)
        ids[column < n[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        pair = np.full((len(pieces), width), _NONE, np.int32)
        inner = column[:-1] < n[:, None] - 1
        pair[:, :-1][inner] = self.pair_ranks(ids[:, :-1][inner], ids[:, 1:][inner])
        result, lengths = np.empty_like(ids), n.copy()
        rows = np.arange(len(pieces))
        while len(rows):
            at = pair.argmin(axis=1)  # the first of the least
            every = np.arange(len(rows))
            rank = pair[every, at]
            done = rank == _NONE
            if done.any():  # compaction: finished rows leave, and columns that no row needs
                result[rows[done], :width] = ids[done]
                lengths[rows[done]] = n[done]
                go = ~done
                rows, n, at, rank = rows[go], n[go], at[go], rank[go]
                if not len(rows):
                    break
                width = int(n.max())
                ids, pair = ids[go, :width], pair[go, :width]
                every = np.arange(len(rows))
            ids[every, at] = rank
            column = np.arange(width)
            source = column + (column > at[:, None])  # what stood right of the merged pair moves up by one
            source[:, -1] = width - 1
            ids, pair = np.take_along_axis(ids, source, 1), np.take_along_axis(pair, source, 1)
            n = n - 1
            pair[every, n - 1] = _NONE
            left = np.flatnonzero(at > 0)
            pair[left, at[left] - 1] = self.pair_ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < n - 1)
            pair[right, at[right]] = self.pair_ranks(ids[right, at[right]], ids[right, at[right] + 1])
        return result[np.arange(result.shape[1]) < lengths[:, None]], lengths

    def _long(self, piece: bytes) -> np.ndarray:
        """One long piece: the same merges in the same order, from a heap of pairs along a linked list."""
        ids, n = self.single[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[j]])
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank(x, y)) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _piece_ids(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        whole: list[str] = []
        ranks: list[int] = []
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode()
            if raw in self.ranks:
                whole.append(p)
                ranks.append(self.ranks[raw])
            elif len(raw) <= MATRIX_BYTES:
                by_length.setdefault((len(raw) + 3) // 4, []).append((p, raw))
            else:
                by_length.setdefault(0, []).append((p, raw))
        keys, flat, lengths = whole, [np.array(ranks, np.int32)], [np.ones(len(whole), np.int64)]
        for p, raw in by_length.pop(0, []):
            keys.append(p)
            flat.append(self._long(raw))
            lengths.append(np.array([len(flat[-1])]))
        for quarter, found in sorted(by_length.items()):
            step = max(1, CELLS // (4 * quarter))
            for k in range(0, len(found), step):
                ids, n = self._matrix([raw for _, raw in found[k : k + step]])
                keys += [p for p, _ in found[k : k + step]]
                flat.append(ids)
                lengths.append(n)
        return keys, np.concatenate(flat), np.concatenate(lengths)

    def _chunk_ids(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        found = [self.quick.findall(x) if self.plain(x) else self.pattern.findall(x) for x in new]
        ids, each_piece = self.pieces.ids_at(self.pieces.rows(found))
        return new, ids, sums(each_piece, np.fromiter(map(len, found), np.int64, len(found)))

    def encode_all(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        return self.memo.ids_of([chunks(x) for x in rows])

    def forget(self) -> None:
        """Drop what is remembered of past texts; the tables of the rank file stay."""
        self.pieces.clear()
        self.memo.clear()

    def decode(self, ids: np.ndarray) -> bytes:
        length = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(length)
        return self.pool[np.repeat(self.offsets[ids] - (ends - length), length) + np.arange(int(length.sum()))].tobytes()


def bpe(path: str) -> ByteBPE:
    if path not in _made:
        _made[path] = ByteBPE(path)
    return _made[path]


def _each(name: str, whole: bool):
    """Chunks are remembered within a task only: an idle worker holds none."""
    return each(_tokens(name, whole), lambda: bpe(public_tokenizers.path(name)).forget())


def _tokens(name: str, whole: bool):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        coder, rows, parts = bpe(public_tokenizers.path(name)), texts(b), []
        for i, j in slices(list(map(len, rows))):
            ids, n = coder.encode_all(rows[i:j])
            parts += [ids[e - k : e] for e, k in zip(np.cumsum(n).tolist(), n.tolist())]
        raw = [p.astype("<u4").tobytes() for p in parts]
        out = {"doc_id": b.column("doc_id"), "n_tokens": list(map(len, parts)), "decoded_sha256": [hashlib.sha256(coder.decode(p)).hexdigest() for p in parts]}
        return batches(out | ({"ids": raw} if whole else {"ids_sha256": [hashlib.sha256(x).hexdigest() for x in raw]}), _IDS_SCHEMA if whole else _SCHEMA)

    return run


def token_digests(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes that the ids decode to).

    A null or empty text has no ids. A text of any length is encoded whole; a piece without borders of more than
    MATRIX_BYTES bytes costs n log n. Repeated rows give repeated results. Other columns are not read.
    """
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _each(name, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """As token_digests, but with the ids themselves (little-endian unsigned 32-bit integers)."""
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _each(name, True), "doc_id long, n_tokens long, ids binary, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spread(table(spark, sf_dir, "documents")))


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document: doc_id, n_tokens, ids, decoded_sha256. A null or empty text has no ids, one of any
    length is encoded whole, repeated rows give repeated results, an empty table none; other columns are not read."""
    return token_ids(docs)
