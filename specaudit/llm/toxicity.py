"""Toxicity scores by a convolutional text classifier over hashed word embeddings.

Words are runs of letters and digits, lower-cased. A word has the summed embeddings of the hashes of itself and of its
beginnings (`BEGINNINGS` bytes), as far as they occur in `MIN_DOCS` sampled documents. Filters of several widths and max pooling lead to a
logistic score (`text_cnn`). A whole text is scored at once, whatever its length, and a task works the products of words
and filters out once per distinct word of a few megabytes of text.

Thresholds are calibrated by language: the language of a text is guessed from its own words, by their frequencies in the
sampled documents of each language, and the threshold of a language is the one with the best F1 over all labelled rows that
are not held out, of any length. To its counts those of all languages are added, weighed as `PRIOR` toxic rows, so a rare
language leans on the common threshold and a frequent one goes its own way, without a switch between them. No row is judged by a network that was fitted to its text: rows of sampled texts are scored by one of `FOLDS` networks fitted
without their part of the sample, all others by the final one. Tasks score rows in place; only ids and score bins (`BIN` of
a logit wide) meet the labels, and only counts by language, label and bin reach the driver. The score is shifted so that the
threshold is 0.5.

Learning: of the labelled rows that are not held out, `SAMPLE_TOXIC` toxic and `SAMPLE_CLEAN` clean ones, first in order
of a hash of the id, with at most `SAMPLE_LENGTH` words each. These bounds set what reaches the driver, where the networks
are trained in numpy. Labels, language, source and id are never inputs of a score.

Edge cases: null text is scored like an empty one. Null labels, and labels of unknown documents, are not learnt from; of
several labels of one document the highest counts. Without both labels every score is 0. One row per input row; a row with
a null doc_id is scored, and is not held out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specaudit.llm import text_cnn
from specaudit.llm.batches import sliced, text_bytes, word_borders, word_hashes

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_LENGTH = 2000, 3000, 2048
MIN_DOCS, PRIOR = 3, 20
FOLDS = 3
BIN, BINS = 1 / 64, 1 << 12  # bins on either side of a logit of 0
BEGINNINGS = (6, 8)
SIZE, FILTERS, EPOCHS = 16, 8, 6

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): text i has the words features[first[i]:first[i + 1]], each the hashes of itself and its beginnings."""
    data, borders = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, first = word_borders(_WORD[data], borders)
    whole = word_hashes(data, starts, ends)
    parts = [np.where(ends - starts > n, word_hashes(data, starts, np.minimum(ends, starts + n)) ^ np.uint64(n), 0) for n in BEGINNINGS]
    return np.stack([whole, *parts], 1), first


@dataclass(frozen=True)
class Model:
    """`keys`: sorted hashes, number k is row k + 1 of the embeddings; `share`: log frequencies by row and language."""

    keys: np.ndarray
    params: text_cnn.Params | None
    languages: tuple[str, ...]
    share: np.ndarray
    thresholds: np.ndarray

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == hashes[known]
        return np.where(known & (hashes != 0), at + 1, 0)


def guessed(model: Model, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of the likeliest language of each text."""
    total = np.concatenate((np.zeros((1, len(model.languages))), np.cumsum(model.share[numbers[:, 0]], axis=0, dtype=np.float64)))
    return (total[first[1:]] - total[first[:-1]]).argmax(1)


def _best_threshold(counts: np.ndarray) -> float:
    """Half way between the two bins around the cut with the best F1, for counts by label (clean, toxic) and score bin."""
    held = np.flatnonzero(counts.sum(0))[::-1]
    clean, hits = counts[:, held].cumsum(1)
    k = int((2 * hits / (hits + clean + hits[-1])).argmax())
    low = (held[k] - BINS) * BIN
    return float((low + (held[k + 1] + 1 - BINS) * BIN) / 2) if k + 1 < len(held) else float(low - 1)


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learnt(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, length: int = SAMPLE_LENGTH, epochs: int = EPOCHS) -> Model:
    """A model from the labelled rows of `docs` (doc_id, text, lang) and `labels` (doc_id, toxic)."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi")
    some = [known.where(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for kind, n in (("toxic = 1", toxic), ("toxic = 0", clean))]
    ids = some[0].unionByName(some[1])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            hashes, first = words_of(part.column("text"))
            items = pa.ListArray.from_arrays(pa.array(first * hashes.shape[1], pa.int32()), pa.array(hashes.ravel().view(np.int64)))
            kept = pa.array(np.flatnonzero(np.diff(first) <= length))
            columns = [c.take(kept) for c in (part.column("doc_id"), part.column("lang"), part.column("toxic"), part.column("place"), items)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "toxic", "place", "words"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).join(F.broadcast(ids), "doc_id")
    rows = rows.withColumn("place", F.xxhash64("text")).mapInArrow(read, "doc_id long, lang string, toxic int, place long, words array<long>")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.hash("words")).limit(toxic + clean).toArrow()
    label = np.asarray(sample.column("toxic").to_numpy(), dtype=int)
    if not (label == 1).any() or not (label == 0).any():
        return Model(np.zeros(0, np.uint64), None, (), np.zeros((1, 0)), np.zeros(0))
    texts = [np.asarray(x.values).view(np.uint64).reshape(-1, 1 + len(BEGINNINGS)) for x in sample.column("words")]
    spoken = sample.column("lang").to_pylist()
    found, docs_with = np.unique(np.concatenate([np.unique(t) for t in texts]), return_counts=True)
    keys = found[docs_with >= MIN_DOCS]
    languages = tuple(sorted({x for x in spoken if x is not None})) or ("",)
    bare = Model(keys, None, languages, np.zeros((len(keys) + 1, len(languages))), np.zeros(len(languages)))
    numbers = [bare.numbers(t) for t in texts]
    counts = np.full((len(keys) + 1, len(languages)), 0.1)
    for n, lang in zip(numbers, spoken):
        if lang is not None:
            np.add.at(counts[:, languages.index(lang)], n[:, 0], 1)
    share = np.log(counts / counts.sum(0))
    share[0] = 0  # words without an embedding tell nothing about the language
    places = np.asarray(sample.column("place").to_numpy(), dtype=np.int64)
    fold = places % FOLDS
    fitted = [fold != k for k in range(FOLDS)] + [np.ones(len(texts), bool)]  # the last one is final
    params = [text_cnn.trained([numbers[i] for i in np.flatnonzero(own)], label[own], len(keys) + 1, SIZE, FILTERS, epochs) for own in fitted]
    models = [Model(keys, p, languages, share.astype(np.float32), np.zeros(len(languages))) for p in params]
    counts = _counted(docs, known, models, np.unique(places))
    common = counts.sum(0)
    toxic_rows = common[1].sum()
    limits = [_best_threshold(own + common * (PRIOR / toxic_rows)) if toxic_rows else 0.0 for own in counts]
    return Model(keys, params[-1], languages, models[-1].share, np.array(limits))


def _counted(docs: DataFrame, known: DataFrame, models: list[Model], places: np.ndarray) -> np.ndarray:
    """Rows with a label in `known` by guessed language, label and score bin; texts with a hash in `places` by their fold's model."""

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sliced(batches):
            place = np.asarray(whole.column("place"))
            which = np.where(np.isin(place, places), place % FOLDS, FOLDS)
            for k in np.unique(which):
                part = whole.take(pa.array(np.flatnonzero(which == k)))
                hashes, first = words_of(part.column("text"))
                numbers = models[k].numbers(hashes)
                at = np.clip(np.floor(_logits(models[k], numbers, first) / BIN), -BINS, BINS - 1).astype(np.int64) + BINS
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(guessed(models[k], numbers, first), pa.int64()), pa.array(at)], ["doc_id", "tongue", "bin"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("doc_id").isNotNull() & ~_held_out())
    rows = rows.withColumn("place", F.xxhash64("text")).mapInArrow(binned, "doc_id long, tongue long, bin long")
    found = rows.join(known.where("toxic in (0, 1)"), "doc_id").groupBy("tongue", "toxic", "bin").count()
    out = np.zeros((len(models[-1].languages), 2, 2 * BINS), np.int64)
    for tongue, toxic, at, n in found.collect():
        out[tongue, toxic, at] = n
    return out


def _logits(model: Model, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    key = numbers[:, 0] + (numbers[:, 1:] * np.array([1 << 21, 1 << 42])).sum(1)  # fewer than 2 ** 21 features
    _, one, row = np.unique(key, return_index=True, return_inverse=True)
    return text_cnn.logits(model.params, numbers[one], row, first)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, guessed_lang) of every row of (doc_id, text)."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            hashes, first = words_of(part.column("text"))
            n = len(first) - 1
            if model.params is None:
                value, tongue = np.zeros(n), [None] * n
            else:
                numbers = model.numbers(hashes)
                language = guessed(model, numbers, first)
                value = 1 / (1 + np.exp(-np.clip(_logits(model, numbers, first) - model.thresholds[language], -50, 50)))
                tongue = [model.languages[k] for k in language]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value), pa.array(tongue, pa.string())], ["doc_id", "score", "guessed_lang"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double, guessed_lang string").select(
        "doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "guessed_lang")
