"""Token-ID files: documents' ids in ascending order of doc_id, entropy-coded; and reading them back.

A file set is a Parquet folder. Each row is one segment: consecutive whole documents of one range of doc_ids with a
frequency table that all its blocks share. A block holds whole documents and is decoded without any other. Spark's
own writer commits the rows, so a lost task leaves nothing behind.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batches, release, scratch, slices, small, table, tune
from .memo import sums
from .rans import Coder, Corrupt, frequencies, pack_table, unpack_table
from .shingles import LOWER, buffers, word_hashes, words

END_ID = 2
#: A block or segment ends with the document that brings it to this many ids.
BLOCK_IDS, SEGMENT_IDS = 1 << 18, 1 << 21
#: Words that a worker remembers before it forgets all, and words of one call of the library.
MEMO_WORDS, JOINED = 1 << 21, 1 << 14
_SEGMENT = "part int, segment int, doc_ids binary, no_id binary, n_ids binary, freq binary, blocks array<binary>, block_docs array<int>"
_SEGMENT_SCHEMA = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.binary()), ("no_id", pa.binary()), ("n_ids", pa.binary()), ("freq", pa.binary()), ("blocks", pa.list_(pa.binary())), ("block_docs", pa.list_(pa.int32()))])
_OUT = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
#: A special token's beginning, combining marks, invisible characters and white space but the plain space.
_ODD = regex.compile(r"<\||[\p{C}\p{M}]|[^\P{Z} ]")
#: Kinds of bytes: 1 for a letter or digit, 2 for other visible ASCII but the apostrophe, 0 for all others.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[[39, *range(48, 58), *range(65, 91), *range(97, 123)]] = [0] + [1] * 62
_made: dict[str, WordIds] = {}


class WordIds:
    """The tokenizers library's ids of whole texts, made word by word.

    The file's normalizer composes characters, folds white space and lowers letters, and its pattern drops white
    space, so ids of a text are those of its words between spaces. The pattern also parts letters and digits from
    other ASCII characters, save after an apostrophe, so words are cut there. Words are found and hashed on the Arrow buffer, and
    a hash is looked up in a table of the words met so far. New words go through the library many at a time, joined by
    spaces; its offsets tell whose ids are whose. Words with other white space, a special token's string, combining
    marks or invisible characters go through it one by one, and any file with other parts than these gets whole texts.
    Two of a worker's n words share a hash with a probability of about n * n / 2**65.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.clear()
        self.by_word = self._fits()

    def clear(self) -> None:
        self.table, self.place = np.zeros(1 << 17, np.uint64), np.zeros(1 << 17, np.int32)
        self.n, self.starts, self.ids = 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 17, np.int32)

    def _fits(self) -> bool:
        probe = "Don't STOP it's  naïve école, 12ab3\n x\t¿qué? ÀÉ. ﬁ Σ 漢字 <|endoftext|> we'll--go (a).b \"é\"'s ..'s a×b"
        try:
            return all(x.startswith("<|") for x in self.special) and self._by_words(pa.array([probe]))[0].tolist() == self._whole(probe)
        except Exception:  # a model of another kind
            return False

    def _whole(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words, one after the other, and how many each has."""
        odd = np.zeros(len(new), bool)
        if _ODD.search(" ".join(new)):
            odd[:] = [bool(_ODD.search(w)) for w in new]
        n, parts = np.zeros(len(new), np.int64), {}
        plain = np.flatnonzero(~odd)
        for at in (plain[i : i + JOINED] for i in range(0, len(plain), JOINED)):
            words_ = [new[i] for i in at.tolist()]
            got = self.lib.encode(" ".join(words_), add_special_tokens=False)
            begin = np.cumsum([0] + [len(w) + 1 for w in words_[:-1]])
            of = np.searchsorted(begin, np.fromiter((a for a, _ in got.offsets), np.int64, len(got)), "right") - 1
            n[at] = np.bincount(of, minlength=len(at))
            parts[int(at[0])] = np.array(got.ids, np.int32)
        whole = {i: self._whole(new[i]) for i in np.flatnonzero(odd).tolist()}
        for i, x in whole.items():
            n[i] = len(x)
        out, begin = np.empty(int(n.sum()), np.int32), np.cumsum(n) - n
        if len(plain):
            out[_places(begin[plain], n[plain])] = np.concatenate(list(parts.values()))
        for i, x in whole.items():
            out[begin[i] : begin[i] + len(x)] = x
        return out, n

    def _grow(self, more: int) -> None:
        size = len(self.table)
        while size < 2 * (self.n + more):
            size *= 2
        if size != len(self.table):
            used = np.flatnonzero(self.table)
            keys, values = self.table[used], self.place[used]
            self.table, self.place = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(keys, values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Linear probes, one for all distinct new keys at a time."""
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.table[slot] == 0)
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.table[slot[put]], self.place[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.table) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that the table lacks."""
        slot = self._slot(keys)
        at = self.table[slot]
        out = np.where(at == keys, self.place[slot], -1)
        open_ = np.flatnonzero((at != keys) & (at != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.table) - 1)
            at = self.table[slot[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.place[slot[open_[hit]]]
            open_ = open_[~hit & (at != 0)]
        return out

    def _by_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = buffers(column)
        marks = (raw[:-1] == 60) & (raw[1:] == 124)  # special tokens begin so, and only in lower case
        data = raw if marks.any() else LOWER[raw]
        starts, ends, first = words(data, offsets) if marks.any() else pieces(data, offsets)
        keys = word_hashes(data, starts, ends)
        keys[keys == 0] = 1
        at = self._find(keys)
        if (at < 0).any():
            if self.n > MEMO_WORDS:
                self.clear()
                at[:] = -1
            missing = np.flatnonzero(at < 0)
            new, one = np.unique(keys[missing], return_index=True)
            one = missing[one]
            text = data.tobytes()
            ids, n = self._encoded([text[i:j].decode() for i, j in zip(starts[one].tolist(), ends[one].tolist())])
            held, end = int(self.starts[self.n]), self.n + len(new)
            self._grow(len(new))
            self._put(new, np.arange(self.n, end, dtype=np.int32))
            if end + 1 > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros(end + 1, np.int64)])
            if held + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(held + len(ids), np.int32)])
            self.ids[held : held + len(ids)] = ids
            self.starts[self.n + 1 : end + 1] = held + np.cumsum(n)
            self.n = end
            at[missing] = self._find(keys[missing])
        begin = self.starts[at]
        n = self.starts[at + 1] - begin
        return self.ids[_places(begin, n)], sums(n, np.diff(first))

    def ids_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id, and how many each row has. A null counts as empty."""
        if self.by_word:
            ids, n = self._by_words(column)
        else:
            got = [self._whole(x or "") for x in column.to_pylist()]
            n = np.fromiter(map(len, got), np.int64, len(got))
            ids = np.fromiter((i for x in got for i in x), np.int32)
        out = np.full(len(ids) + len(n), END_ID, np.int32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(n + 1) - 1] = False
        out[keep] = ids
        return out, n + 1


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words(), but a word is cut where a letter or digit and another visible ASCII character meet."""
    starts, ends, _ = words(data, offsets)
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))  # U+00C0 to U+023F are letters but for two signs, and one that is lowered to a letter and a mark
    second = data[lead + 1]
    letter = np.where(data[lead] == 0xC3, (second != 0x97) & (second != 0xB7), (data[lead] != 0xC4) | (second != 0xB0))
    kind[(lead + 1)[letter]] = 1
    before = kind[:-1] * kind[1:] == 2
    # of a letter of two bytes the second has the kind, the first the one of its successor
    kind[lead] = kind[lead + 1]
    after = kind[:-1] * kind[1:] == 2
    cut = np.flatnonzero(before | (after & (data[:-1] < 0x80))) + 1
    inner = np.searchsorted(starts, cut, "right") - 1
    cut = cut[(inner >= 0) & (cut < ends[inner]) & (cut > starts[inner])] if len(starts) else cut[:0]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def _places(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (n[0] of them), then the same for the next."""
    out = np.repeat(begin - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


def tokenizer(name: str) -> WordIds:
    path = public_tokenizers.path(name)
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]


def _segment(part: int, number: int, doc_ids: np.ndarray, no_id: np.ndarray, n: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    freq = frequencies(ids)
    coder = Coder(freq)
    ends = np.cumsum(n)
    blocks, block_docs, i, at = [], [], 0, 0
    while i < len(n):
        j = min(len(n), int(np.searchsorted(ends, at + BLOCK_IDS)) + 1)
        blocks.append(coder.encode(ids[at : ends[j - 1]]))
        block_docs.append(j - i)
        i, at = j, ends[j - 1]
    row = {"part": [part], "segment": [number], "doc_ids": [doc_ids.astype("<i8").tobytes()], "no_id": [np.packbits(no_id).tobytes()], "n_ids": [n.astype("<i8").tobytes()], "freq": [pack_table(freq)], "blocks": [blocks], "block_docs": [block_docs]}
    return batches(row, _SEGMENT_SCHEMA)


def _write(name: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, held, size, part = tokenizer(name), 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            return _segment(part, number, *[np.concatenate(x) for x in zip(*held)])

        try:
            for b in it:
                part = b.column("part")[0].as_py() if b.num_rows else part
                no_id = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                doc_ids = b.column("doc_id").fill_null(0).to_numpy()
                text = b.column("text")
                for i, j in slices(np.diff(buffers(text)[1]).tolist()):
                    ids, n = coder.ids_of(text.slice(i, j - i))
                    held.append((doc_ids[i:j], no_id[i:j], n, ids.astype(np.uint32)))
                    size += len(ids)
                    if size >= SEGMENT_IDS:
                        yield flush()
                        number, held, size = number + 1, [], 0
            if held:
                yield flush()
        finally:
            release()

    return run


def write_ids(docs: DataFrame, path: str, name: str = "word_bpe_49k.json") -> None:
    """docs(doc_id, text): a null text counts as empty and has the end id only; null doc_ids come first and stay null.
    Documents are dealt into ranges of doc_id before they are tokenized, so the work is done once. Documents with the
    same doc_id follow each other in any order, and may be dealt to several tasks if there are very many. A document
    longer than a block is a block of its own. Columns other than doc_id and text are not read."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    sorted_ = ranges.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    sorted_.mapInArrow(_write(name), _SEGMENT).write.option("compression", "uncompressed").parquet(path)


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for r in b.to_pylist():
            doc_ids, n = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["n_ids"], "<i8")
            coder, crc, d = Coder(unpack_table(r["freq"])), [], 0
            for block, k in zip(r["blocks"], r["block_docs"]):
                ids = coder.decode(block).astype("<u4")
                ends = np.cumsum(n[d : d + k])
                if len(ids) != ends[-1]:
                    raise Corrupt("a block holds other documents than its directory")
                crc += [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends.tolist(), n[d : d + k].tolist())]
                d += k
            before = np.cumsum(n) - n
            no_id = np.unpackbits(np.frombuffer(r["no_id"], np.uint8), count=len(n)).astype(bool)
            yield batches({"part": np.full(len(n), r["part"]), "doc_id": pa.array(doc_ids, mask=no_id), "before": before, "n_tokens": n, "ids_crc32": crc}, _OUT)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files. Segments are decoded in any order and
    anywhere; a wrong checksum fails the task."""
    files = spark.read.schema(_SEGMENT).parquet(path)
    # the sizes of segments, a few hundred bytes for each two million ids, give every segment its start
    sizes = files.select("part", "segment", F.expr("octet_length(n_ids) div 8").alias("docs"), "n_ids").mapInArrow(_sizes, "part int, segment int, ids long")
    starts = sizes.groupBy("part").agg(F.sum("ids").alias("ids")).collect()
    at, of_part = 0, {}
    for r in sorted(starts):
        of_part[r["part"]], at = at, at + r["ids"]
    # within a part: an exclusive sum over its few segments
    segments = sizes.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("segment", "ids"))).alias("s"))
    parts = spark.createDataFrame(list(of_part.items()) or [], "part int, part_start long")
    inner = segments.join(parts, "part").select(
        "part", F.posexplode("s").alias("i", "x"), "part_start", "s").select(
        "part", F.col("x.segment").alias("segment"),
        (F.col("part_start") + F.aggregate(F.slice("s", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["ids"])).alias("segment_start"))
    # a row for each segment: broadcast if they are few, so that the blocks aren't moved for one number each
    decoded = files.join(small(inner), ["part", "segment"]).select("segment_start", *files.columns)
    out = decoded.mapInArrow(_read_started, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out


def _sizes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("ids", pa.int64())])
    for b in it:
        ids = [int(np.frombuffer(x.as_py(), "<i8").sum()) for x in b.column("n_ids")]
        yield batches({"part": b.column("part"), "segment": b.column("segment"), "ids": ids}, schema)


def _read_started(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in it:
        for i in range(b.num_rows):
            start = b.column("segment_start")[i].as_py()
            for out in _read(iter([b.slice(i, 1)])):
                before = out.column("before").to_numpy() + start
                yield batches({"doc_id": out.column("doc_id"), "start": before, "n_tokens": out.column("n_tokens"), "ids_crc32": out.column("ids_crc32")}, schema)


def op5_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path)
