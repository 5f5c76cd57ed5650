"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads each run of non-space bytes of a text (a longer run in windows of `WINDOW` bytes), labels every
position with a probability per language, and a document's probability of a language is the mean over its letter
positions. The state starts anew at every run, so equal runs have equal labels: a task works each distinct run out once,
remembers it, and adds up the occurrences. Whole texts are read; the cost follows the number of distinct words.

Learning: per language, the texts of `SAMPLE_DOCS` labelled documents (those first in order of a hash of the id), of their
distinct runs the `SAMPLE_WORDS` first in order of a hash. These bounds, not the corpus, set what reaches the driver,
where the network is trained in numpy by backpropagation through time. Held-out documents are never learnt from, and
language, source and id are never inputs of a prediction.

Edge cases: null text or text without a letter is `und` with score 0, as is everything when no labelled document exists.
Ties go to the language first in alphabetical order. A row with a null doc_id is predicted but not learnt from and not
held out. One row per input row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from specaudit.llm import gru
from specaudit.llm.batches import SLICE_BYTES, sliced, text_bytes, tidied, word_borders, word_hashes

WINDOW = 24
SAMPLE_DOCS, SAMPLE_WORDS = 300, 20_000  # per language
HIDDEN, EPOCHS = 32, 3
MEMO = 500_000  # runs remembered by one worker; beyond that it starts anew, with the same results
TOGETHER = 1024  # windows of one length that pass through the network together
UNKNOWN = "und"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    params: gru.Params


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first) of the runs of all texts, longer ones cut; text i has windows first[i]:first[i + 1]."""
    data, borders = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, first = word_borders(~_SPACE[data], borders)
    parts = np.maximum(1, -(-(ends - starts) // WINDOW))
    bounds = np.concatenate(([0], np.cumsum(parts)))
    if bounds[-1] > len(starts):
        nth = np.arange(bounds[-1]) - np.repeat(bounds[:-1], parts)
        starts = np.repeat(starts, parts) + nth * WINDOW
        ends = np.minimum(np.repeat(ends, parts), starts + WINDOW)
    return data, starts, ends, bounds[first]


def pooled(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per window, the sums over its letter positions of 1 and of each language's probability."""
    out = np.zeros((len(starts), 1 + len(model.languages)), np.float32)
    sizes = ends - starts
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        for at in range(0, len(same), TOGETHER):
            own = same[at : at + TOGETHER]
            codes = data[starts[own, None] + np.arange(n)]
            prob, _ = gru.probabilities(model.params, codes)
            letter = _LETTER[codes]
            out[own, 0] = letter.sum(1)
            out[own, 1:] = np.einsum("tnl,nt->nl", prob, letter, optimize=True)
    return out


class _Memo:
    """Pooled sums by window hash."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.sums = np.zeros((0, 1 + len(self.model.languages)), np.float32)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, row): the sums of the distinct windows, and the row of each window."""
        keys, one, row = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        sums = np.empty((len(keys), self.sums.shape[1]), np.float32)
        sums[known] = self.sums[at[known]]
        sums[~known] = pooled(self.model, data, starts[one[~known]], ends[one[~known]])
        if len(self.keys) + int((~known).sum()) > MEMO:
            self._clear()
        order = np.argsort(merged := np.concatenate((self.keys, keys[~known])), kind="stable")
        self.keys, self.sums = merged[order], np.concatenate((self.sums, sums[~known]))[order]
        return sums, row


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learnt(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Model:
    """A model from the labelled rows of (doc_id, text, lang) that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    usable = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    languages = sorted(r[0] for r in usable.select("lang").distinct().collect())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            data, starts, ends, _ = windows(part.column("text"))
            keys, one, times = np.unique(word_hashes(data, starts, ends), return_index=True, return_counts=True)
            words = [data[starts[i] : ends[i]].tobytes() for i in one]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["key", "word", "n"])

    codes: list[np.ndarray] = []
    labels: list[int] = []
    weights: list[float] = []
    for k, language in enumerate(languages):
        own = usable.where(F.col("lang") == language)
        ids = own.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)  # narrow scan, then few texts
        texts = own.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("text")
        words = texts.mapInArrow(tidied(count), "key long, word binary, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))
        for r in words.orderBy("key", "word").limit(sample_words).select("word", "n").collect():
            codes.append(np.frombuffer(r[0], np.uint8))
            labels.append(k)
            weights.append(min(float(r[1]), 20.0) ** 0.5)
    if len(languages) < 2 or not codes:
        return Model(tuple(languages), gru.init(hidden, max(1, len(languages))))
    share = np.bincount(labels, weights, len(languages))
    weighed = np.array(weights) / share[labels]  # every language counts the same
    params = gru.trained(codes, np.array(labels), weighed * len(codes), _LETTER, hidden, len(languages), epochs)
    return Model(tuple(languages), params)


def predicted(docs: DataFrame, model: Model, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """`docs` with lang_pred, score and n_positions (letter bytes labelled); column names must be free."""
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("n_positions", "long")

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(model)
        for part in sliced(batches, most=slice_bytes):
            texts = part.column("text")
            data, starts, ends, first = windows(texts)
            sums, row = memo(data, starts, ends)
            total = np.zeros((len(texts), sums.shape[1]))
            held = np.flatnonzero(np.diff(first))
            if len(held):
                step = 1 << 18  # windows added up together
                for a in range(0, len(held), 256):
                    some = held[a : a + 256]
                    lo, hi = first[some[0]], first[some[-1] + 1]
                    if hi - lo <= step or len(some) == 1:
                        total[some] = np.add.reduceat(sums[row[lo:hi]].astype(float), first[some] - lo, axis=0)
                    else:
                        for i in some:
                            total[i] = sums[row[first[i] : first[i + 1]]].sum(0, dtype=float)
            plain = np.flatnonzero(total[:, 0])
            # Bytes beyond ASCII may be other than letters: texts without a plain letter are looked at one by one.
            ascii_ = np.add.reduceat(np.concatenate((_LETTER[data] & (data < 0x80), [False])), _text_starts(texts)) > 0
            for i in plain[~ascii_[plain]]:
                if not any(c.isalpha() for c in texts[i].as_py()):
                    total[i] = 0
            share = total[:, 1:] / np.maximum(total[:, :1], 1)
            best = share.argmax(1) if len(model.languages) else np.zeros(len(texts), int)
            known = (total[:, 0] > 0) & bool(model.languages)
            named = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            score = np.where(known, np.clip(share[np.arange(len(texts)), best], 0, 1), 0.0) if model.languages else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(named, pa.string()), pa.array(score), pa.array(total[:, 0].astype(np.int64))], names=[*part.schema.names, "lang_pred", "score", "n_positions"])

    return docs.mapInArrow(tidied(label), schema)


def _text_starts(texts: pa.Array) -> np.ndarray:
    return text_bytes(texts)[1][:-1]


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_positions) of every row of (doc_id, text, lang)."""
    model = model or learnt(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predicted(rows, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "n_positions")


def in_known_language(docs: DataFrame, model: Model | None = None, least: float = 0.3) -> DataFrame:
    """The rows of `docs` whose text has letters and a language scored `least` or more; the same columns."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]).cast("string"))
    kept = predicted(plain, model or learnt(docs), SLICE_BYTES // 4).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
