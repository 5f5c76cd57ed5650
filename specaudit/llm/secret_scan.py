"""Secret scans: three pattern kinds, and a randomness test battery for strings that no pattern names.

Patterns, leftmost and non-overlapping per kind, matches that are too short dropped: `assign` (a keyword, a colon or equals
sign, a value of 6 characters or more), `access` (access-key ids of 20 or more) and `hex` (24 or more).

The battery takes every run of `MIN_LENGTH` or more letters, digits and + / _ - of a text and infers its encoding: the
smallest of hex, base32 and base64 whose alphabet holds it. Runs of digits alone are numbers and are left out. Then:

* Alphabet uniformity. The chi-squared statistic against a uniform alphabet of k characters is k / n * sum of squared
  counts - n. It is compared with what it would be for ordinary text, whose letter frequencies are counted over the whole
  corpus: mean and variance follow from the sums of squares and cubes of those frequencies. Random strings lie far below
  it, the farther the longer they are; a short one cannot, so length decides what can be found.
* A random string must also pass as one: the same statistic against its uniform expectation, a runs test about the middle
  of the alphabet and a lag-1 serial correlation, each two-sided, together at level `GATE`.
* False discoveries are held to a share `FDR` by Benjamini and Hochberg's procedure within each length class, so the many
  short words do not drown the few long strings. It works on counts of scores in bins of fixed width over all runs of the
  corpus; a bin takes its upper edge, so the bound holds.

Two scans of the texts: the first counts letters and scores (a few hundred rows reach the driver, whatever the input), the
second emits spans. Spans of the battery have kind `random`, and are added where no pattern span covers them. All offsets
are code points, ends exclusive.

Edge cases: null text is empty and has no spans. One row per input row, repeated rows and null ids included. A corpus
without candidate runs has no cut-offs and no `random` spans. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.llm.batches import sliced, text_bytes, tidied, word_borders
from specaudit.session import cut

MIN_LENGTH, GATE, FDR = 20, 1e-3, 0.01
BIN = 0.05  # width of a score bin, in standard deviations
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(characters.encode(), np.uint8)] = True
    return out


_DIGITS, _SMALL, _LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = _table(_DIGITS + "abcdef")
_RUN = _table(_DIGITS + _SMALL + _LARGE + "+/_-")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _alphabet(*characters: str) -> np.ndarray:
    """The place of each byte in an alphabet, -1 outside; several spellings of one alphabet share places."""
    out = np.full(256, -1, np.int16)
    for spelling in characters:
        out[np.frombuffer(spelling.encode(), np.uint8)] = np.arange(len(spelling))
    return out


# Smallest first; each with its size.
ENCODINGS = [
    ("hex", 16, _alphabet(_DIGITS + "abcdef")), ("hex_upper", 16, _alphabet(_DIGITS + "ABCDEF")),
    ("base32", 32, _alphabet(_LARGE + "234567")), ("base64", 64, _alphabet(_LARGE + _SMALL + _DIGITS + "+/", _LARGE + _SMALL + _DIGITS + "-_")),
]


def length_class(n: int) -> int:
    return n.bit_length()  # 16 to 31, 32 to 63, ...


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def tested(run: bytes) -> tuple[int, int, int, bool] | None:
    """(encoding, length, equal pairs, passes as random) of a run, or None for numbers and strings in no encoding.

    The number of equal pairs of characters carries the chi-squared statistic: sum of squared counts = n + 2 * pairs.
    """
    raw = np.frombuffer(run, np.uint8)
    n = len(raw)
    if n < MIN_LENGTH or run.isdigit():
        return None
    for number, (_, k, places) in enumerate(ENCODINGS):
        values = places[raw]
        if values.min() >= 0:
            break
    else:
        return None
    counts = np.bincount(values, minlength=k)
    pairs = int((counts * (counts - 1)).sum() // 2)
    both = n * (n - 1) / 2
    uniform = (pairs - both / k) / math.sqrt(both * (1 / k) * (1 - 1 / k))
    high = values >= k // 2
    above = int(high.sum())
    below = n - above
    if not above or not below or values.std() == 0:
        return number, n, pairs, False
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * above * below / n + 1
    spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    centred = values - values.mean()
    serial = float((centred[1:] * centred[:-1]).sum() / (centred**2).sum()) * math.sqrt(n)
    worst = min(_tail(uniform), _tail((runs - mean) / spread), _tail(serial))
    return number, n, pairs, worst * 3 >= GATE


def _ordinary(letters: dict[int, int]) -> list[tuple[float, float]]:
    """Per encoding, sums of squared and cubed letter frequencies of ordinary text."""
    out = []
    for _, k, places in ENCODINGS:
        counts = np.zeros(k)
        for byte, n in letters.items():
            if places[byte] >= 0:
                counts[places[byte]] += n
        share = counts / counts.sum() if counts.sum() else np.full(k, 1 / k)
        out.append((float((share**2).sum()), float((share**3).sum())))
    return out


@dataclass(frozen=True)
class Cutoffs:
    """What the first scan learns: ordinary letter sums, and the highest score bin that counts, by length class."""

    ordinary: tuple[tuple[float, float], ...]
    bins: dict[int, int]

    def score_bin(self, encoding: int, n: int, pairs: int) -> int:
        return score_bin(self.ordinary[encoding], n, pairs)

    def found(self, run: bytes) -> bool:
        t = tested(run)
        return t is not None and t[3] and self.score_bin(*t[:3]) <= self.bins.get(length_class(t[1]), -(1 << 30))


def score_bin(ordinary: tuple[float, float], n: int, pairs: int) -> int:
    s2, s3 = ordinary
    both = n * (n - 1) / 2
    variance = both * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * max(s3 - s2 * s2, 0.0)
    return math.floor((pairs - both * s2) / math.sqrt(max(variance, 1e-12)) / BIN)


def discoveries(bins: dict[int, int], fdr: float) -> int | None:
    """The highest bin whose scores are discoveries, from counts by bin; a score of bin b is below (b + 1) * BIN."""
    m, seen, best = sum(bins.values()), 0, None
    for b in sorted(bins):
        seen += bins[b]
        p = math.erfc(-(b + 1) * BIN / math.sqrt(2)) / 2
        if p * m <= fdr * seen:
            best = b
    return best


def _runs(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, _ = word_borders(_RUN[data], borders)
    keep = ends - starts >= MIN_LENGTH
    return starts[keep], ends[keep]


def calibrated(docs: DataFrame, fdr: float = FDR) -> Cutoffs:
    """The first scan."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.zeros(256, np.int64)
        for part in sliced(batches):
            data, borders = text_bytes(part.column("text"))
            letters += np.bincount(data, minlength=256)
            found = [t for s, e in zip(*_runs(data, borders)) if (t := tested(data[s:e].tobytes())) is not None]
            if found:
                columns = [pa.array(c, pa.int64()) for c in list(zip(*found))[:3]]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(found), pa.int64())], ["encoding", "n", "pairs", "times"])
        seen = np.flatnonzero(letters)
        empty = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), empty, empty, pa.array(letters[seen])], ["encoding", "n", "pairs", "times"])

    rows = cut(docs.selectExpr("cast(text as string) text").mapInArrow(tidied(count), "encoding long, n long, pairs long, times long"))
    letters = {r[0]: r[1] for r in rows.where("n is null").groupBy("encoding").agg(F.sum("times")).collect()}  # at most 256
    ordinary = tuple(_ordinary(letters))
    s2 = F.element_at(F.array(*(F.lit(a) for a, _ in ordinary)), F.col("encoding").cast("int") + 1)
    s3 = F.element_at(F.array(*(F.lit(b) for _, b in ordinary)), F.col("encoding").cast("int") + 1)
    n, both = F.col("n"), F.col("n") * (F.col("n") - 1) / 2
    variance = both * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * F.greatest(s3 - s2 * s2, F.lit(0.0))
    score = F.floor((F.col("pairs") - both * s2) / F.sqrt(F.greatest(variance, F.lit(1e-12))) / BIN)
    # Scores beyond the reach of a double's tail are as good as the last bin on that side.
    scored = rows.where("n is not null").select(F.length(F.bin("n")).alias("size"), F.greatest(F.least(score, F.lit(200)), F.lit(-800)).alias("bin"))
    classes: dict[int, dict[int, int]] = {}
    for size, b, times in scored.groupBy("size", "bin").count().collect():  # 1,000 bins for each length class
        classes.setdefault(size, {})[b] = times
    best = {size: discoveries(bins, fdr) for size, bins in classes.items()}
    return Cutoffs(ordinary, {size: b for size, b in best.items() if b is not None})


def spans(text: bytes, runs: Iterable[tuple[int, int]], hexes: Iterable[tuple[int, int]], cutoffs: Cutoffs) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of one text, given its runs and hex runs; base kinds first at equal starts."""
    out = [(s, 2, e) for s, e in hexes]
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base = list(out)
    out += [(s, 3, e) for s, e in runs if cutoffs.found(text[s:e]) and not any(a <= s and e <= b for a, _, b in base)]
    return sorted(out)


def _found(texts: pa.Array, cutoffs: Cutoffs) -> Iterator[list[tuple[int, int, int]]]:
    """Spans of each text, in code points."""
    data, borders = text_bytes(texts)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    low = _LOWER[data].tobytes()
    whole = data.tobytes()
    marked = np.zeros(len(texts), bool)
    for needle in (*_KEYWORDS, b"akia"):
        at = low.find(needle)
        while at >= 0:
            doc = int(np.searchsorted(borders, at, "right")) - 1
            marked[doc] = True
            at = low.find(needle, int(borders[doc + 1]))  # one hit a text is enough
    starts, ends = _runs(data, borders)
    first = np.searchsorted(starts, borders)
    hs, he, _ = word_borders(_HEX[data], borders)
    keep = he - hs >= 24
    hs, he = hs[keep], he[keep]
    hfirst = np.searchsorted(hs, borders)
    for i in range(len(texts)):
        a, b = int(borders[i]), int(borders[i + 1])
        if not marked[i] and first[i] == first[i + 1] and hfirst[i] == hfirst[i + 1]:
            yield []
            continue
        runs = list(zip((starts[first[i] : first[i + 1]] - a).tolist(), (ends[first[i] : first[i + 1]] - a).tolist()))
        hexes = list(zip((hs[hfirst[i] : hfirst[i + 1]] - a).tolist(), (he[hfirst[i] : hfirst[i + 1]] - a).tolist()))
        base = points[a]
        yield [(int(points[a + s] - base), k, int(points[a + e] - base)) for s, k, e in spans(whole[a:b], runs, hexes, cutoffs)]


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def secret_spans(docs: DataFrame, cutoffs: Cutoffs | None = None) -> DataFrame:
    """One row per row of (doc_id, text): counts by kind, the digest of the pattern spans, and all spans."""
    cutoffs = cutoffs or calibrated(docs)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            found = list(_found(part.column("text"), cutoffs))
            count = lambda kind: pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64())
            digests = [hashlib.sha256(listed([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), count(0), count(1), count(2), pa.array(digests, pa.string()), pa.array(map(listed, found), pa.string()), count(3)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(scan, RESULT)


def redacted(text: str, found: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with every span replaced by the mark; overlapping spans share one."""
    out, at = [], 0
    for s, _, e in sorted(found):
        if e > at:
            if s >= at:
                out += [text[at:s], mark]
            at = e
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, cutoffs: Cutoffs | None = None) -> DataFrame:
    """The same rows and columns, with secrets in `text` replaced; a null text stays null."""
    cutoffs = cutoffs or calibrated(docs)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            found = list(_found(part.column("text"), cutoffs))
            texts = part.column("text").to_pylist()
            fresh = [redacted(t, f) if f else t for t, f in zip(texts, found)]
            yield part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(fresh, part.column("text").type))

    return docs.mapInArrow(tidied(clean), docs.schema)
