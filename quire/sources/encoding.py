"""Decoding of raw bytes: byte order marks, then candidates scored on a prefix; an Arrow UDF, as Spark's own decoders are few."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import common_han
from ..session import ship

#: Bytes that the candidates are scored on.
SAMPLE = 96 * 1024
CANDIDATES = ("utf-8", "gb18030", "big5")
#: A candidate of a score not above this isn't offered.
LEAST_SCORE = -100.0
_RARE = re.compile("[\u3400-\u4dbf\uf900-\ufaff]")
_HAN = re.compile("[\u4e00-\u9fff]")
#: What hardly stands in a text: controls and what can't be decoded. Bytes of UTF-16 read otherwise hold many of them.
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]")
RESULT = "encoding string, text string, replaced long"


def score(text: str, common: frozenset[str]) -> float:
    if not text or text.isascii():
        return 0.0
    han = _HAN.findall(text)
    return len(han) / len(text) * 100 + 0.5 * sum(map(common.__contains__, han)) - 60 * text.count("\ufffd") - 10 * len(_RARE.findall(text))


def _share(text: str, common: frozenset[str]) -> float:
    han = _HAN.findall(text)
    return sum(map(common.__contains__, han)) / max(1, len(han))


def _read_otherwise(sample: bytes, part: str, common: frozenset[str]) -> bool:
    """Whether a candidate reads the sample as a text, of which UTF-16 would pair the letters to Han characters (``part``):
    next to nothing odd, and those characters are less often frequent ones, which the text's own are and chance ones aren't.
    Of 48 pairs UTF-16 is hardly ever another encoding's text, so there half of them have to be frequent."""
    share, pairs = _share(part, common), len(sample) // 2
    for text in (sample.decode(n, "replace") for n in CANDIDATES):
        if len(_ODD.findall(text)) * 50 <= pairs and share < max(_share(text, common), 0.5 if pairs >= 48 else 0):
            return True
    return False


def _utf16(raw: bytes, sample: bytes, common: frozenset[str]) -> tuple[str, str, int] | None:
    """UTF-16 without a mark: bytes that ASCII text doesn't have, few pairs of ASCII, nothing to replace, readable
    and not the letters of another encoding in pairs."""
    if sample.isascii() and 0 not in sample:
        return None
    pairs = np.frombuffer(sample, np.uint8)[: len(sample) // 2 * 2].reshape(-1, 2)
    if len(pairs) >= 8 and int(((pairs >= 32) & (pairs < 127)).all(axis=1).sum()) > 0.6 * len(pairs):
        return None
    parts = {n: sample[: len(sample) // 2 * 2].decode(n, "replace") for n in ("utf-16-le", "utf-16-be")}
    for name, part in sorted(parts.items(), key=lambda x: -score(x[1], common)):  # stable
        if "\ufffd" not in part and score(part, common) >= 60 and not _read_otherwise(sample, part, common) and "\ufffd" not in (text := raw.decode(name, "replace")):
            return name.replace("utf-16-", "utf-16"), text, 0
    return None


def candidates(raw: bytes | None, common: frozenset[str] = frozenset(common_han())) -> list[tuple[str, float]]:
    """The encodings that may be offered for a text, with their scores on its sample, best first."""
    sample = (raw or b"")[:SAMPLE]
    found = [(n, score(sample.decode(n, "replace"), common)) for n in CANDIDATES]
    return sorted((x for x in found if x[1] > LEAST_SCORE), key=lambda x: -x[1])  # stable


def detect(raw: bytes | None, common: frozenset[str] = frozenset(common_han())) -> tuple[str, str, int]:
    raw = raw or b""
    if raw[:3] == b"\xef\xbb\xbf":
        raw = raw[3:]
    elif raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        name = "utf-16-le" if raw[0] == 0xFF else "utf-16-be"
        text = raw[2:].decode(name, "replace")
        return name.replace("utf-16-", "utf-16"), text, text.count("\ufffd")
    if not raw:
        return "utf-8", "", 0
    sample = raw[:SAMPLE]
    if found := _utf16(raw, sample, common):
        return found
    if sample.isascii():  # no candidate scores more than another
        text = raw.decode("utf-8", "replace")
        return "utf-8", text, text.count("\ufffd")
    best = max(CANDIDATES, key=lambda n: score(sample.decode(n, "replace"), common))  # the first of equals
    text = raw.decode(best, "replace")
    return best, text, text.count("\ufffd")


def _decode(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for values in column:
        yield pd.DataFrame([detect(x) for x in values], columns=["encoding", "text", "replaced"])


def decoded(raw: Column) -> Column:
    """struct of encoding, text and replaced (the number of U+FFFD)."""
    if spark := SparkSession.getActiveSession():
        ship(spark)
    return F.pandas_udf(_decode, RESULT)(raw)


def _candidates(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in column:
        yield pd.Series([[{"encoding": n, "score": x} for n, x in candidates(v)] for v in values])


def candidate_pool(raw: Column) -> Column:
    """array of (encoding, score): what may be offered for bytes whose encoding isn't known, best first."""
    if spark := SparkSession.getActiveSession():
        ship(spark)
    return F.pandas_udf(_candidates, "array<struct<encoding:string,score:double>>")(raw)
