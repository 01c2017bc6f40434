"""Secret scans: patterns, and strings that a public vocabulary needs many tokens for."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, each, spread, table, texts, tune

#: The kinds, in their order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Strings that the token test looks at: as long as a key, with a letter. Their parts are what lies between / = _ and -.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")
LEAST_LENGTH = 20
PART = re.compile(r"[^/=_-]+")
#: Digests by their length, UUIDs, and words joined by - _ / with at most a number each are known identifiers.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|sha(?:256|384|512)-[A-Za-z0-9+/]+=*)\Z")
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\Z")
IDENTIFIER = re.compile(r"(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+|[A-Za-z]+[0-9]{1,4})(?:[-_/=+]+(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+|[A-Za-z]+[0-9]{1,4}))+\Z")
#: UUIDs within a longer string, parts that may be words, and how long a part without a word's form must be to count as readable.
INNER_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
WORD = re.compile(r"(?:[A-Za-z]?[a-z]{3,}|[A-Z]{4,}|[0-9]{4,}|[A-Za-z]{3,}[0-9]{1,4})\Z")
READABLE = 12
#: Characters per token at and below which a string counts as random.
MOST_CHARS = 2.0
MARK = "[SECRET]"

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])
_made: dict[str, tiktoken.Encoding] = {}


def encoding(name: str) -> tiktoken.Encoding:
    if name not in _made:
        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[name]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of what the patterns find; leftmost, without overlaps within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _outside(start: int, end: int, merged: list[list[int]], ends: list[int]) -> list[tuple[int, int]]:
    """What of start:end lies in none of the merged spans."""
    out = []
    for s, e in merged[bisect_right(ends, start) :]:
        if s >= end:
            break
        if s > start:
            out.append((start, s))
        start = e
    return out + [(start, end)] if start < end else out


def random_parts(x: str, is_random: Callable[[str], bool]) -> list[tuple[int, int]]:
    """The random strings in x: x itself, or runs of its parts without readable ones, or single parts."""
    if DIGEST.match(x) or UUID.match(x):
        return []
    if not IDENTIFIER.match(x) and is_random(x):
        return [(0, len(x))]
    known = [m.span() for m in INNER_UUID.finditer(x)]
    runs: list[list[tuple[int, int]]] = [[]]
    for s, e in _outside(0, len(x), [list(k) for k in known], [e for _, e in known]):
        for m in PART.finditer(x, s, e):
            word = m[0]
            if DIGEST.match(word) or ((len(word) >= READABLE or WORD.match(word)) and not is_random(word)):
                runs.append([])
            else:
                runs[-1].append(m.span())
        runs.append([])
    out = []
    for run in runs:
        whole = x[run[0][0] : run[-1][1]] if run else ""
        if len(whole) < LEAST_LENGTH:
            continue
        if not IDENTIFIER.match(whole) and any(c.isalpha() for c in whole) and is_random(whole):
            out.append((run[0][0], run[-1][1]))
        else:
            out += [(s, e) for s, e in run if e - s >= LEAST_LENGTH and not x[s:e].isdigit() and is_random(x[s:e])]
    return out


def random_spans(text: str, taken: list[tuple[int, int, int]], name: str, most: float) -> list[tuple[int, int, int]]:
    out = []
    merged = unions(taken)
    ends = [e for _, e in merged]
    is_random = lambda x: len(x) <= most * len(encoding(name).encode_ordinary(x))
    for m in CANDIDATE.finditer(text):
        for s, e in _outside(m.start(), m.end(), merged, ends):
            x = text[s:e]
            if len(x) >= LEAST_LENGTH and any(c.isalpha() for c in x):
                out += [(s + a, 3, s + b) for a, b in random_parts(x, is_random)]
    return out


def find(text: str, name: str = "byte_bpe_50k.tiktoken", most: float = MOST_CHARS) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, base, name, most))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def unions(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """Starts and ends, where spans that overlap or touch are one."""
    out: list[list[int]] = []
    for s, _, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with MARK in place of each span; spans that overlap or touch become one."""
    out, at = [], 0
    for s, e in unions(spans):
        out += [text[at:s], MARK]
        at = e
    return "".join(out) + text[at:]


def _scan(name: str, most: float):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(x, name, most) for x in texts(b)]
        count = lambda k: [sum(x[1] == k for x in s) for s in found]
        base = [hashlib.sha256(joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
        return batches({"doc_id": b.column("doc_id"), "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": base, "spans": [joined(s) for s in found], "n_random": count(3)}, _SCHEMA)

    return run


def secret_spans(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken", most: float = MOST_CHARS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans are in code points, end exclusive. A string of 20 or more letters, digits and +/_=- with a letter is random
    if it has at most ``most`` characters per token; digests of usual lengths, UUIDs and joined words are excluded, and
    so is what a pattern has found, but not the rest of its string. Of a string that isn't random, runs of parts
    between / = _ - without readable parts, and single parts, are judged alike. Null counts as empty; such rows have no spans. Repeated rows
    give repeated results. Other columns are not read.
    """
    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        each(_scan(name, most)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(spread(table(spark, sf_dir, "documents")))


def stage_secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; MARK replaces each secret. Null texts stay null, empty ones empty; texts of any length are
    looked at whole, an empty table stays empty, and columns of any name stay as they are (but n_chars follows the text)."""
    tune(spark)
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        old = b.column(at).to_pylist()
        new = [redact(x, find(x)) if x else x for x in old]
        columns = b.columns
        columns[at] = pa.array(new, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    out = docs.mapInArrow(each(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
