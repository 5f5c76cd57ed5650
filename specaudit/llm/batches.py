"""Arrow batches as bytes: word borders and 64-bit word hashes for many texts at once, in numpy.

Used inside tasks only. Work arrays are bounded by `SLICE_BYTES` and `BLOCK_BYTES`, not by a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20  # texts worked on together; one longer text makes a slice of its own
BLOCK_BYTES = 1 << 20  # bytes hashed together
GROUP_BYTES = 1 << 20  # groups from this size on give their memory back one by one

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def free_name(columns: Iterable[str], name: str) -> str:
    """The name, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about `most` bytes of text."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def give_back() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def tidied(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work`, before and after which free memory goes back to the system: a Python worker outlives its task and waits for another stage's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from work(batches)
        give_back()

    return run


def tidied_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """`work` on one group, after which free memory goes back to the system if the group was large."""

    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        if table.nbytes >= GROUP_BYTES:
            give_back()
        return out

    return run


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, borders): text i is bytes[borders[i]:borders[i + 1]]; a null text is empty."""
    flat = pc.fill_null(texts, "").cast(pa.large_binary())
    borders = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[borders[0] : borders[-1]], borders - borders[0]


def word_borders(inside: np.ndarray, borders: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of `inside` that cross no text border; text i has words first[i]:first[i + 1].

    `cuts`: more places before which a run ends.
    """
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[borders] = True
    if cuts is not None:
        cut[:-1] |= cuts
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:-1] = inside
    starts = np.flatnonzero(inside & (~before[:-1] | cut[:-1]))
    ends = np.flatnonzero(inside & (~after[1:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, borders)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    return up(_BASE), up(_BASE_INVERSE)


_TABLES = [_powers(BLOCK_BYTES + 4096)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: a polynomial in the bytes, from running sums, then mixed."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, base + BLOCK_BYTES)))
        size = int(ends[to - 1] - base)
        if size >= len(_TABLES[0][0]):
            powers, inverse = _powers(size + 1)  # one word longer than a block
        else:
            powers, inverse = _TABLES[0]
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((data[base : base + size].astype(np.uint64) + np.uint64(1)) * powers[:size], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * inverse[s]
        at = to
    return mixed(out ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): one hash per `width` consecutive words of a text, texts apart."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], counts)
    mix = np.zeros(len(at), np.uint64)
    for k in range(width):
        mix = mixed(mix * np.uint64(0xFF51AFD7ED558CCD) + words[at + k])
    return mix, bounds
