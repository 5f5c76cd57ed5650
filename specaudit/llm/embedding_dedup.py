"""Embedding near-dedup with randomised-rotation binary codes and exact recomputation where the estimate leaves a doubt.

*Codes.* A unit vector u is rotated at random, x = R u; its code is the signs of x, that is the corner b of the cube with
sides +-1 / sqrt(d) nearest to x, and its stored correction factor is f = <b, x>. For a query rotated the same way,
<b, q> / f is an unbiased estimate of the cosine, since the part of b that is orthogonal to x points anywhere alike; its
error is sqrt(1 - f * f) / f / sqrt(d - 1) times a standard normal. `DOUBT` such errors bound it; a pair whose estimate
plus bound stays below the threshold is not recomputed. All other pairs are, in double precision, and only what is then at
or above the threshold links.

*Candidates.* Bits of a code differ for two vectors at angle a with probability a / pi. Each of several independent
rotations gives one band of the first bits; two vectors meet where a band agrees. Band width grows with the logarithm of
the number of vectors, so buckets of unrelated vectors keep their size, and the number of bands is set so that a pair right
at the threshold is met with probability `RECALL` or more. A pair that meets in several bands is counted in the first.

*Groups.* Equal vectors are folded into one, with a count. A bucket is dealt to chunks of bounded size, and every pair of
chunks is compared in one task, as a block of matrix products; a task gives out, for each of its vectors, a number of
links, and a star for each group linked inside it, never pairs. Nothing is capped.

Edge cases: a null vector, and one that is zero, has null or non-finite parts, or overflows, links with nothing. Vectors
of different lengths are not compared. Every row is a vector of its own, repeated rows too. A row with a null vec_id takes
part, but is never the smallest id. `kept` is true for a row without links. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.operators.graph import components
from specaudit.session import cut

COSINE, RECALL, DOUBT = 0.95, 0.99, 4.0
BUCKET = 256  # unrelated vectors in a bucket, about
CHUNK = 512  # vectors of a bucket compared with another such chunk in one task
SEED = 20240501


def plan(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band, bands) for a number of vectors."""
    bits = min(60, max(6, math.ceil(math.log2(max(2, vectors / BUCKET)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-agree))


def rotation(d: int, number: int) -> np.ndarray:
    """The number-th random orthogonal matrix of this size; the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d, number]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows, usable) in double precision; scaled first, so that neither large nor small parts overflow."""
    v = vectors.astype(np.float64)
    with np.errstate(all="ignore"):
        usable = np.isfinite(v).all(1)
        v = np.where(usable[:, None], v, 0)
        top = np.abs(v).max(1, initial=0)
        v = v / np.where(top > 0, top, 1)[:, None]
        norm = np.sqrt((v * v).sum(1))
        usable &= norm > 0
        return v / np.where(norm > 0, norm, 1)[:, None], usable


def units_of(raw: list[bytes], d: int) -> np.ndarray:
    """Unit vectors from the bytes of vectors of one length, in single or double precision."""
    return unit(np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * d else np.float64).astype(np.float64) for x in raw]))[0]


def codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as +-1, correction factors) under the first rotation."""
    x = units @ rotation(units.shape[1], 0).T
    sign = np.where(x >= 0, 1.0, -1.0)
    return sign, (sign * x).sum(1) / math.sqrt(units.shape[1])


def estimated(sign: np.ndarray, factor: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, error bounds of one standard deviation) of the cosines of coded rows with rotated query rows."""
    d = sign.shape[1]
    value = (queries @ sign.T) / math.sqrt(d) / factor
    error = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, d - 1))
    return value, np.broadcast_to(error, value.shape)


def bands(units: np.ndarray, bits: int, count: int) -> np.ndarray:
    """(rows, count) band keys, from rotations 1, 2, ...; wide bands take the bits of several."""
    n, d = units.shape
    out = np.zeros((n, count), np.int64)
    number, pool = 1, np.zeros((n, 0), bool)
    for k in range(count):
        while pool.shape[1] < bits:
            pool = np.concatenate([pool, units @ rotation(d, number).T >= 0], 1)
            number += 1
        out[:, k] = pool[:, :bits] @ (1 << np.arange(bits, dtype=np.int64))
        pool = pool[:, bits:]
    return out


def _folded(vectors: DataFrame) -> DataFrame:
    """(vec_id, fp, raw, d): every row with its vector as bytes and their digest; unusable rows have none."""

    def read(batches):
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            fps: list[bytes | None] = [None] * batch.num_rows
            raw: list[bytes | None] = [None] * batch.num_rows
            flat = np.asarray(pc.list_flatten(lists).cast(pa.float64()).to_numpy(zero_copy_only=False), float)  # null parts become NaN
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for d in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == d)
                own = flat[starts[rows, None] + np.arange(d)]
                with np.errstate(all="ignore"):
                    single = own.astype(np.float32)
                for i, ok, x, y in zip(rows, unit(own)[1], own, single):
                    if ok:  # in single precision where that loses nothing
                        raw[i] = (y if np.array_equal(y, x) else x).tobytes()
                        fps[i] = hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(fps, pa.binary()), pa.array(raw, pa.binary()), pa.array(sizes, pa.int64())], ["vec_id", "fp", "raw", "d"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(read, "vec_id long, fp binary, raw binary, d long")


_OUT = "fp binary, links long, rep binary"


def _compared(cosine: float, doubt: float):
    """Compares the left chunk of a group with its right one, or a chunk with itself."""

    def one(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        band = table.column("band")[0].as_py()
        right = np.asarray(table.column("right"))
        fps = np.array(table.column("fp").to_pylist(), dtype=object)
        times = np.asarray(table.column("times"))
        units = units_of(table.column("raw").to_pylist(), d)
        keys = np.stack(table.column("keys").to_pylist()) if len(fps) else np.zeros((0, 1))
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        alone = table.column("l")[0].as_py() == table.column("r")[0].as_py()
        b = a if alone else b
        sign, factor = codes(units[b])
        turned = units[a] @ rotation(d, 0).T
        value, error = estimated(sign, factor, turned)
        i, j = np.nonzero(value + doubt * error >= cosine - 1e-9)
        if alone:
            i, j = i[i < j], j[i < j]
        links = np.zeros(len(fps), np.int64)
        up = np.arange(len(fps))

        def find(k):
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        for at in range(0, len(i), 1 << 18):
            x, y = a[i[at : at + (1 << 18)]], b[j[at : at + (1 << 18)]]
            first = (keys[x] == keys[y]).argmax(1) == band  # compared where they meet first
            x, y = x[first], y[first]
            linked = np.einsum("ij,ij->i", units[x], units[y]) >= cosine
            x, y = x[linked], y[linked]
            np.add.at(links, x, times[y])
            np.add.at(links, y, times[x])
            for p, q in zip(x.tolist(), y.tolist()):
                p, q = find(p), find(q)
                up[max(p, q)] = min(p, q)
        heads = [find(k) for k in range(len(fps))]
        some = np.flatnonzero((links > 0) | (np.array(heads) != np.arange(len(fps))))
        return pa.table({"fp": pa.array(fps[some], pa.binary()), "links": pa.array(links[some]), "rep": pa.array([fps[heads[k]] for k in some], pa.binary())})

    return one


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, doubt: float = DOUBT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    rows = cut(_folded(vectors))
    distinct = cut(rows.where("fp is not null").groupBy("fp", "d").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("times")))
    bits, count = plan(distinct.count(), cosine, recall)

    def keyed(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("d"))
            raw = batch.column("raw").to_pylist()
            keys = np.zeros((len(raw), count), np.int64)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                keys[own] = bands(units_of([raw[i] for i in own], d), bits, count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * count, pa.int32()), pa.array(keys.ravel()))
            yield batch.append_column("keys", lists)

    with_keys = cut(distinct.mapInArrow(keyed, "fp binary, d long, raw binary, times long, keys array<long>"))
    bucket = ["d", "band", "key"]
    met = with_keys.select("fp", "d", F.posexplode("keys").alias("band", "key"))
    sizes = met.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    dealt = met.join(sizes, bucket).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    # Chunk c is the left side of (c, r) for r >= c, and the right side of (l, c) for l < c.
    sides = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda o: F.struct(
        F.least(o, F.col("chunk")).alias("l"), F.greatest(o, F.col("chunk")).alias("r"), (o < F.col("chunk")).alias("right")))
    placed = dealt.select("fp", *bucket, F.explode(sides).alias("s")).select("fp", *bucket, "s.l", "s.r", "s.right")
    group = [*bucket, "l", "r"]
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = placed.join(with_keys.select("fp", "raw", "times", "keys"), "fp").repartition(tasks, *group)
    found = cut(blocks.groupBy(*group).applyInArrow(_compared(cosine, doubt), _OUT))
    groups = components(found.where("fp <> rep").select(F.col("fp").alias("src"), F.col("rep").alias("dst"))).select(F.col("node").alias("fp"), F.col("component").alias("rep"))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    per_set = distinct.select("fp", "times").join(links, "fp", "left").join(groups, "fp", "left").select(
        "fp", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("rep", "fp").alias("rep"))
    labelled = cut(rows.select("vec_id", "fp").join(per_set, "fp", "left"))
    lowest = labelled.where("rep is not null").groupBy("rep").agg(F.min("vec_id").alias("component_id"))
    named = labelled.join(lowest, "rep", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("rep").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return named.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
