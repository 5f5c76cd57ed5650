"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

The cost of a piece of n tokens is estimated as linear * n + quadratic * n * n. Pieces are taken in descending order of
cost, and each goes to the sequence of lowest cost that still has room; what does not fit there is cut off and goes on to
the next such sequence. Pieces of full length are a sequence by themselves.

Documents are tokenised where they are read, cut into pieces of one sequence at most, and the pieces dealt by a hash of
the row's place in the input to groups of about `GROUP_TOKENS`. No id, text, source or group of copies makes a group
large, and very short documents make no small one. A group is packed by one task; it has as few sequences as its tokens
allow, so at most one sequence's worth of padding a group. Rows are numbered where they are read: the input should come
from files, so that a task that is run again numbers its rows alike.

Edge cases: null text is empty, and is packed as its closing id alone. Rows with a null doc_id are packed like others;
repeated rows are documents of their own. Ties are broken by doc_id (nulls last) and start. No rows give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.llm.batches import sliced, tidied, tidied_group
from specaudit.llm.pretokens import TOKEN_SLICE, Vocabulary

GROUP_TOKENS = 1 << 18
TOKEN_BYTES = 5  # on average, not to make groups too small; a token has one byte at least, so they are bounded too
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

PIECE = "row long, doc_id long, start long, length long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _vocabulary(path: str) -> Vocabulary:
    """One per task: a worker that outlives the task keeps nothing of it."""
    return Vocabulary(path, lambda tokens: struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens]))


def tokenised(docs: DataFrame, path: str, capacity: int, closing: int) -> DataFrame:
    """(row, doc_id, start, length, doc_tokens, ids) pieces of at most `capacity` ids; ids are little-endian 32-bit words."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        vocabulary = _vocabulary(path)
        end, width = struct.pack("<I", closing), 4 * capacity
        for part in sliced(batches, most=TOKEN_SLICE):
            out: list[tuple] = []
            for row, doc, text in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                ids = b"".join(vocabulary.values(vocabulary.split(text or ""))) + end
                total = len(ids) // 4
                if total <= capacity:
                    out.append((row, doc, 0, total, total, ids))
                else:
                    out.extend((row, doc, at // 4, len(piece := ids[at : at + width]) // 4, total, piece) for at in range(0, len(ids), width))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["row", "doc_id", "start", "length", "doc_tokens", "ids"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(tidied(cut), PIECE)


def balanced(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, length, sequence, offset) for pieces of at most `capacity`, each token placed once."""
    cost = lambda n: linear * n + quadratic * n * n
    out, sequence = [], 0
    parts = []
    for k, n in enumerate(lengths):
        if n == capacity:
            out.append((k, 0, n, sequence, 0))
            sequence += 1
        elif n:
            parts.append(k)
    parts.sort(key=lambda k: -cost(lengths[k]))
    open_ones = [(0.0, sequence + s, 0) for s in range(-(-sum(lengths[k] for k in parts) // capacity))]
    for k in parts:
        done = 0
        while done < lengths[k]:
            spent, s, used = heapq.heappop(open_ones)
            n = min(lengths[k] - done, capacity - used)
            out.append((k, done, n, s, used))
            done += n
            if used + n < capacity:
                heapq.heappush(open_ones, (spent + cost(n), s, used + n))
    return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, closing: int = 1) -> DataFrame:
    """One row per piece, with its ids, its sequence and its offset there. See the module for the method."""
    rows, size = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    groups = max(1, (rows + size // TOKEN_BYTES) // GROUP_TOKENS)

    def one(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("start", "ascending")])
        group = table.column("grp")[0].as_py()
        doc, start, total, ids = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
        placed = balanced(table.column("length").to_pylist(), capacity)
        cut = [ids[k][4 * a : 4 * (a + n)] for k, a, n, _, _ in placed]
        columns = [
            [doc[k] for k, *_ in placed], [start[k] + a for k, a, *_ in placed], [n for _, _, n, _, _ in placed],
            [zlib.crc32(x) for x in cut], [total[k] for k, *_ in placed], [(group << 24) + s for *_, s, _ in placed], [o for *_, o in placed],
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([*(pa.array(c, pa.int64()) for c in columns), pa.array(cut, pa.binary())], names=[*names, "ids"])

    pieces = tokenised(docs, path, capacity, closing).withColumn("grp", F.pmod(F.xxhash64("row", "start"), F.lit(groups))).drop("row")
    return pieces.groupBy("grp").applyInArrow(tidied_group(one), PACKED)
