"""Benchmark decontamination by templates: finds benchmark items in documents, also with other numbers, names and units.

Canonical form: a word that starts with a digit, or is a number word, becomes NUMBER; a unit right after a number becomes
UNIT; a capitalised word inside a sentence becomes NAME; other words are lower-cased. Windows of `WIDTH` consecutive
words (of all words, for shorter items) are hashed, and document windows meet item windows in a hash join. Every window is
hashed as its plain lower-cased words, so a copy in capitals, of names and numbers only or within another sentence is still
a copy; a window with placeholders is hashed as its template too, unless it has more placeholders than words and so says
too little.

Slot consistency: windows of one document and item that lie on one diagonal (same shift between the two texts) should fill
the item's slots consistently. A window counts if each of its item values has, at more than half of the places where the
diagonal holds that value, the document value that the window has; a window whose slots all kept their own values counts
always, as do windows of equal plain words. So a slip in one mention costs the windows around it and no others, and a chance
likeness, which fills its slots at random, is dropped. An item is found when the windows that count cover at least `SHARE` of
all its positions, those without a usable template included; `verbatim` tells whether every slot of a diagonal kept its own
value.

Scale: documents are scanned once. A bitmap of the item windows of fixed size (`BITS`, filled fuller by a larger benchmark,
never larger) goes to the tasks, which emit only windows that can match; the exact join, its choice left to the optimizer,
decides. Aggregates are by (document, item), so a passage that a third of all documents share spreads over all of them.

Edge cases: null or empty texts have no windows. Items of fewer than `LEAST` words or without text are never found, items
of placeholders only where their plain words stand. Rows repeat in the result only if (doc_id, item_id) differ; a null doc_id is reported as null. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specaudit.llm.batches import SLICE_BYTES, free_name, sliced, text_bytes, tidied, window_hashes, word_borders, word_hashes
from specaudit.session import cut

WIDTH, LEAST, SHARE = 8, 5, 0.5
BITS = 1 << 24

# Number words and units of measure.
_NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
_UNITS = "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs ml l liter liters litre litres gallon gallons second seconds sec s minute minutes min hour hours h day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres mph kph hz khz mhz ghz w kw mw v kv j kj cal kcal bit bits byte bytes kb mb gb tb".split()

NUMBER, UNIT, NAME = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127), np.uint64(0xB492B66FBE98F273)

_DIGIT, _ALPHA, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_ALPHA[ord("a") : ord("z") + 1] = _ALPHA[ord("A") : ord("Z") + 1] = _ALPHA[0x80:] = True
_STOP[[ord(c) for c in ".!?:\n"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LATIN = 0xC3  # the first byte of the accented letters of Latin-1; the second tells which, capitals in 0x80 to 0x9E


def _lowered(data: np.ndarray) -> np.ndarray:
    out = _LOWER[data]
    second = np.flatnonzero(data[:-1] == _LATIN) + 1
    code = data[second]
    out[second[(code >= 0x80) & (code <= 0x9E) & (code != 0x97)]] += 32  # 0x97 is a sign
    return out


def _listed(words: list[str]) -> np.ndarray:
    data, borders = text_bytes(pa.array(words))
    return np.sort(word_hashes(data, borders[:-1], borders[1:]))


_NUMBER_WORDS, _UNIT_WORDS = _listed(_NUMBERS), _listed(_UNITS)


def _in(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template, values, slot, first): per word its template hash, the hash of the word itself, and whether it is a slot."""
    data, borders = text_bytes(texts)
    n = len(data)
    digit, alpha = _DIGIT[data], _ALPHA[data]
    inner = np.zeros(n, bool)  # the point of 3.5 and the comma of 1,000
    inner[1:-1] = ((data == ord(".")) | (data == ord(",")))[1:-1] & digit[:-2] & digit[2:]
    unit_cut = np.zeros(n, bool)  # 5km is a number and a unit
    unit_cut[1:] = digit[:-1] & alpha[1:]
    starts, ends, first = word_borders(digit | alpha | inner, borders, unit_cut)
    values = word_hashes(_lowered(data), starts, ends)
    head = np.zeros(len(starts), bool)
    head[first[:-1][np.diff(first) > 0]] = True
    number = digit[starts] | _in(values, _NUMBER_WORDS)
    unit = _in(values, _UNIT_WORDS)
    unit[1:] &= number[:-1]
    unit &= ~head
    # A sentence starts with a text, or where a stop stands between two words.
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    opening = head.copy()
    opening[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    code = data[starts]
    after = data[np.minimum(starts + 1, max(n - 1, 0))] if n else code
    capital = ((code >= ord("A")) & (code <= ord("Z"))) | ((code == _LATIN) & (after >= 0x80) & (after <= 0x9E))
    name = capital & ~opening & ~number & ~unit
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, values)))
    return template, values, number | unit | name, first


def _windows(texts: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """(hash, text, position, first word, slotted, values, slot) of all windows of plain words and of the usable templates.

    A window that is not `slotted` is one of plain words: what would be slots are words like others.
    """
    template, values, slot, first = templates(texts)
    plain, bounds = window_hashes(values, first, width)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    place = np.arange(len(plain)) - bounds[text]
    at = first[text] + place
    filled = np.concatenate(([0], np.cumsum(slot)))
    slots = filled[at + width] - filled[at]
    usable = np.flatnonzero((slots > 0) & (2 * slots <= width))
    hashes = np.concatenate((plain, window_hashes(template, first, width)[0][usable])) ^ np.uint64(width)
    own = np.concatenate((np.arange(len(plain)), usable))
    slotted = np.arange(len(own)) >= len(plain)
    return hashes, text[own], place[own], at[own], slotted, values, slot


def _held(at: np.ndarray, slotted: np.ndarray, width: int, slot: np.ndarray) -> np.ndarray:
    return slot[at[:, None] + np.arange(width)] & slotted[:, None]


def _lists(held: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held.sum(1)))), pa.int32()), pa.array(values, pa.int64()))


def _slots(at: np.ndarray, held: np.ndarray, values: np.ndarray) -> pa.Array:
    """Per window, the values in its slots, in order."""
    row, spot = np.nonzero(held)
    return _lists(held, values[at[row] + spot].view(np.int64))


def _rows(table: DataFrame, key: str) -> DataFrame:
    return table.selectExpr(f"cast({key} as long) id", "cast(text as string) text").withColumn("place", F.xxhash64("text"))


_WINDOW = "id long, place long, at long, key long, slots array<long>"


def _batch(part: pa.RecordBatch, text: np.ndarray, *columns) -> pa.RecordBatch:
    rows = pa.array(text)
    return pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("place").take(rows), *columns], ["id", "place", "at", "key", "slots"])


def item_windows(items: DataFrame, width: int, least: int) -> DataFrame:
    """(id, place, at, key, slots, width, offsets, n): the windows of every item; `n` counts its positions."""

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            texts = part.column("text")
            sizes = np.diff(templates(texts)[3])
            for w in range(least, width + 1):
                if not (sizes >= w).any() if w == width else not (sizes == w).any():
                    continue
                hashes, text, place, at, slotted, values, slot = _windows(texts, w)
                own = sizes[text] >= width if w == width else sizes[text] == w
                held = _held(at[own], slotted[own], w, slot)
                out = _batch(part, text[own], pa.array(place[own], pa.int64()), pa.array(hashes[own].view(np.int64)), _slots(at[own], held, values))
                out = out.append_column("width", pa.array(np.full(own.sum(), w), pa.int64()))
                out = out.append_column("offsets", _lists(held, np.nonzero(held)[1]))
                yield out.append_column("n", pa.array(sizes[text[own]] - w + 1, pa.int64()))

    return _rows(items, "item_id").mapInArrow(cut_up, f"{_WINDOW}, width long, offsets array<long>, n long").distinct()


def _bitmap(windows: DataFrame) -> np.ndarray:
    """One bit per hash bucket that an item window falls into: at most BITS / 64 rows reach the driver."""
    bucket = F.col("key").bitwiseAND(F.lit(BITS - 1))
    words = windows.select((bucket / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
    out = np.zeros(BITS // 64, np.int64)
    for word, bits in words.groupBy("word").agg(F.bit_or("bit")).collect():
        out[word] = bits
    return out


def contaminated(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, least: int = LEAST, share: float = SHARE, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(doc_id, place, item_id, n_windows, item_windows, share, verbatim): which items each document holds.

    `place` is a hash of the text, which tells rows with one doc_id apart.
    """
    known = cut(item_windows(items, width, least))
    bits = _bitmap(known)
    widths = sorted(r[0] for r in known.select("width").distinct().collect())  # at most width - least + 1

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, most=slice_bytes):
            for w in widths:
                hashes, text, place, at, slotted, values, slot = _windows(part.column("text"), w)
                low = hashes & np.uint64(BITS - 1)
                hit = ((bits[(low >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)
                if hit.any():
                    held = _held(at[hit], slotted[hit], w, slot)
                    yield _batch(part, text[hit], pa.array(place[hit], pa.int64()), pa.array(hashes[hit].view(np.int64)), _slots(at[hit], held, values))

    seen = _rows(docs, "doc_id").mapInArrow(tidied(candidates), _WINDOW)
    asked = known.select(F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("at").alias("item_at"), "key", F.col("slots").alias("item_slots"), "offsets", "n")
    group = ["id", "place", "item_id", "item_place"]
    met = seen.join(asked, "key").withColumn("shift", F.col("at") - F.col("item_at"))
    # An item's windows bound every set below, whatever the document holds.
    slots = F.arrays_zip(F.col("offsets").alias("o"), F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    lines = met.groupBy(*group, "n", "shift").agg(F.collect_set(F.struct(F.col("item_at").alias("at"), slots.alias("slots"))).alias("windows"))
    filled = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.transform(w["slots"], lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))))
    lines = lines.withColumn("filled", filled)
    held = F.size(F.array_distinct(F.transform("filled", lambda x: x["a"]))) == F.size("filled")
    same = F.forall("filled", lambda x: x["a"] == x["b"])
    lines = cut(lines.select(*group, "n", "shift", "windows", held.alias("held"), same.alias("same")))
    steady = lines.where("held").select(*group, "n", "same", F.explode("windows.at").alias("item_at"))
    found = steady.unionByName(_agreeing(lines.where("not held"), [*group, "n", "same"]))
    found = found.groupBy(*group, "n").agg(F.count_distinct("item_at").alias("n_windows"), F.bool_or("same").alias("verbatim"))
    return found.where(F.col("n_windows") >= share * F.col("n")).groupBy(F.col("id").alias("doc_id"), "place", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max_by("n", "n_windows").alias("item_windows"),
        F.max(F.col("n_windows") / F.col("n")).alias("share"), F.bool_or("verbatim").alias("verbatim"))


def _agreeing(lines: DataFrame, columns: list[str]) -> DataFrame:
    """(*columns, item_at): the windows that count, of diagonals where an item value has several document values."""
    line = [*columns, "shift"]
    windows = lines.select(*line, F.explode("windows").alias("w")).select(*line, F.col("w.at").alias("item_at"), F.explode_outer("w.slots").alias("x"))
    slots = windows.select(*line, "item_at", (F.col("item_at") + F.col("x.o")).alias("spot"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    spots = lambda *keys: F.size(F.collect_set("spot").over(Window.partitionBy(*line, *keys)))
    judged = slots.withColumn("all", spots("a")).withColumn("own", spots("a", "b"))
    counts = F.bool_and(F.col("a").isNull() | (2 * F.col("own") > F.col("all"))) | F.bool_and(F.col("a").isNull() | (F.col("a") == F.col("b")))
    return judged.groupBy(*line, "item_at").agg(counts.alias("counts")).where("counts").select(*columns, "item_at")


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, share, verbatim), one row per pair."""
    found = contaminated(docs, items, width, least, share)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max_by("item_windows", "share").alias("item_windows"), F.max("share").alias("share"), F.bool_or("verbatim").alias("verbatim"))


def without_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The rows of `docs` that hold no item, with the same columns; a row with a null doc_id is judged by its text."""
    name, place = free_name(docs.columns, "bad_id"), free_name(docs.columns, "bad_place")
    bad = contaminated(docs, items, width, least, share, SLICE_BYTES // 4).select(F.col("doc_id").alias(name), F.col("place").alias(place)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.xxhash64(F.col("text").cast("string")) == F.col(place))
    return docs.join(bad, same, "left_anti")
