"""Exact n-gram Jaccard join: which documents are linked, as connected groups, by T-occurrence search.

A document's set holds its distinct `width`-word shingles. Two documents link when 100 * |x & y| >= percent * |x | y|.
Sets of sizes a and b link exactly if they share at least T = ceil(p * (a + b) / (100 + p)) shingles, so a search asks an
inverted index for the sets that occur on at least T of a query's lists. DivideSkip answers it: the longest lists are put
aside, the short ones are heap-merged with what is left of T, skipping ahead in lists that cannot matter, and only the
few candidates so found are binary-probed in the long lists.

The search is spread over the cluster without ever gathering a shared shingle in one place:

1. *Folding.* Equal sets are one set, kept under a 128-bit digest. Copies cost one row each from here on.
2. *Blocks.* Linked sets differ in at most d = (a + b) * (100 - p) / (100 + p) shingles. The hash space is cut into about
   1.2 d ranges, and the digest of what a set holds in a range is a key, so linked sets share all but d of their keys. That
   is again an overlap search, over keys: a key that one set alone has can link nothing, so a set stays only if enough of
   its keys are shared with others, and of those only the rarest, as many as may be missing and one more, have to meet.
   One chance agreement, or a passage that many documents share, joins nothing. Sets that share such a key, directly or
   not, form a block; this is a range-partitioned pass over keys and a connected-components run over the few ids left.
3. *Search.* A block is dealt by hash to chunks of bounded size, and every chunk is searched in its own task, where sets
   already known to be in one group are not compared again. Groups of different chunks meet through one representative
   each, in chunks again, until nothing merges. A block in one group is then finished: its size never enters squared.
   Sets outside their block's largest group are finally searched for in all chunks of their block, in bounded tasks.

Shingle hashes have 64 bits: a wrong count needs two equal hashes inside one document or one compared pair (below 1e-10
for texts of 10,000 words). Links are otherwise exact, with no limit on partners, candidates or group sizes.

Edge cases: a text with fewer words than `width` has one shingle, its whole word sequence. Null, empty or blank texts
have the empty set and link with nothing. Every row is a node of its own: rows that repeat are linked as equal sets. A
row with a null doc_id takes part in links but is never the smallest id; a group without any id has a null component_id.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.llm.batches import SLICE_BYTES, free_name, mixed, sliced, text_bytes, tidied, tidied_group, window_hashes, word_borders, word_hashes
from specaudit.operators.graph import components
from specaudit.session import cut

CHUNK_SETS, CHUNK_SHINGLES = 256, 400_000  # of one search task, on average
SMALL_RANGES = 128

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, borders = text_bytes(texts)
    starts, ends, first = word_borders(~_SPACE[data], borders)
    words = word_hashes(_LOWER[data], starts, ends)
    hashes, bounds = window_hashes(words, first, width)
    for i in range(len(texts)):
        if bounds[i + 1] > bounds[i]:
            yield np.unique(hashes[bounds[i] : bounds[i + 1]])
        elif first[i + 1] > first[i]:
            short = words[first[i] : first[i + 1]]
            yield window_hashes(short, np.array([0, len(short)]), len(short))[0] ^ np.uint64(len(short))
        else:
            yield np.zeros(0, np.uint64)


class _Named:
    """Groups of joined names (digests or numbers), kept as parent links towards the smallest."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, name):
        up = self.up
        while (above := up.get(name, name)) != name:
            up[name] = name = up.get(above, above)
        return name

    def join(self, one, other) -> None:
        a, b = self.find(one), self.find(other)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def pairs(self) -> list[tuple]:
        return [(name, self.find(name)) for name in list(self.up)]


# --- block keys -----------------------------------------------------------------


def _class_borders(most: int) -> list[int]:
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 7 // 5))
    return out


_BORDERS = _class_borders(1 << 40)


def _ranges(k: int, percent: int) -> tuple[int, int]:
    """(ranges, most differences) for pairs whose smaller set is in size class k.

    Small sets get so many ranges that most hold one shingle or none, for then hardly any key is a chance agreement.
    """
    a = _BORDERS[k + 1] - 1
    most = (a + a * 100 // percent) * (100 - percent) // (100 + percent)
    return max(most + most // 5 + 1, min(4 * a, SMALL_RANGES)), most


def range_keys(shingles: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """(keys, least) of a set in its own size class and, where a partner may be in the one below, in that.

    The keys are digests of the ranges in which the set holds anything; in the class of the smaller of two linked sets, they
    share `least` or more keys of each. Should that be none, empty ranges are keys too.
    """
    n = len(shingles)
    if n == 0:
        return []
    own = bisect_left(_BORDERS, n + 1) - 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shingles)))
    out = []
    for k in (own, own - 1):
        if k < 0 or k < own and -(-n * percent // 100) >= _BORDERS[own]:
            continue
        m, most = _ranges(k, percent)
        if not most:
            continue  # such sets link only if they are equal
        edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
        at = np.concatenate(([0], np.searchsorted(shingles, edges), [n]))
        digest = mixed(mixed(total[at[1:]] - total[at[:-1]]) ^ mixed(np.uint64(k << 32) + np.arange(m, dtype=np.uint64)))
        held = np.diff(at) > 0
        least = int(held.sum()) - most
        out.append((digest[held], least) if least > 0 else (digest, m - most))
    return out


_DOC = ("doc_id", "place")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, place, text); place, a hash of the text, finds a row again together with its id."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("place", F.xxhash64("text"))


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _id(fp: bytes | None) -> int | None:
    """A name of eight bytes for a set; the last bit is free to tell its two size classes apart."""
    return None if fp is None else int.from_bytes(fp[:8], "little", signed=True) & ~1


def sketched(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, place, n, fp, id, classes): size, digest and range keys of every document's set."""
    kinds = pa.struct([("id", pa.int64()), ("least", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, most=SLICE_BYTES // 4):
            sets = list(shingle_sets(part.column("text"), width))
            fps = [_digest(s) for s in sets]
            ids = [_id(fp) for fp in fps]
            found = [range_keys(s, percent) for s in sets]
            flat = [(i | k, least, keys) for i, classes in zip(ids, found) for k, (keys, least) in enumerate(classes)]
            keys = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum([len(k) for *_, k in flat]))), pa.int32()),
                pa.array(np.concatenate([np.zeros(0, np.uint64), *(k for *_, k in flat)]).view(np.int64)))
            rows = pa.StructArray.from_arrays([pa.array([i for i, *_ in flat], pa.int64()), pa.array([least for _, least, _ in flat], pa.int64()), keys], fields=list(kinds))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("place"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(ids, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(c) for c in found]))), pa.int32()), rows),
            ], ["doc_id", "place", "n", "fp", "id", "classes"])

    return _rows(docs).mapInArrow(tidied(sketch), "doc_id long, place long, n long, fp binary, id long, classes array<struct<id: long, least: long, keys: array<long>>>")


def _by_key(keyed: DataFrame) -> DataFrame:
    """(key, id) rows in order, range-partitioned by both, so a key that many sets have spreads over several tasks."""
    return keyed.select("key", "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, ids, edge) of whole runs of equal keys; the runs at the edges of a partition come alone and may go on elsewhere."""
    key, held, edge = None, [], True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = np.asarray(batch.column("key")), np.asarray(batch.column("id"))
        key = keys[0] if key is None else key
        to = int(np.searchsorted(keys, key, "right"))
        held.append(ids[:to])
        if to == len(keys):
            continue
        open_ids = np.concatenate(held)
        yield np.full(len(open_ids), key), open_ids, edge
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last > to:
            yield keys[to:last], ids[to:last], False
        key, held, edge = keys[-1], [ids[last:]], False
    if key is not None:
        open_ids = np.concatenate(held)
        yield np.full(len(open_ids), key), open_ids, True


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, id, n): the keys that several ids have, with how many have them; for (key, id) rows, which may repeat."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, edge in _runs(batches):
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            keys, ids = keys[new], ids[new]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            n = np.repeat(sizes, sizes)
            keep = np.ones(len(n), bool) if edge else n > 1
            part = np.zeros(int(keep.sum()), np.int64)
            part[:1] = n[0] if edge else 0  # once per partition
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[keep]), pa.array(n[keep]), pa.array(np.full(len(part), edge)), pa.array(part)], ["key", "id", "n", "edge", "part"])

    found = cut(_by_key(keyed).mapInArrow(tidied(counted), "key long, id long, n long, edge boolean, part long"))
    # A run cut by a border between partitions has as many ids as its parts together.
    whole = found.where("part > 0").groupBy("key").agg(F.sum("part").alias("all")).where("all > 1")
    edges = found.where("edge").join(F.broadcast(whole), "key").select("key", "id", F.col("all").alias("n"))  # two keys a partition at most
    return found.where("not edge").select("key", "id", "n").unionByName(edges.distinct())


def meeting_keys(rows: DataFrame) -> DataFrame:
    """(key, id): per set and size class the rarest shared keys, of which linked sets have one in common."""
    classes = rows.select(F.explode("classes").alias("c"))
    shared = cut(shared_keys(classes.select(F.explode("c.keys").alias("key"), F.col("c.id").alias("id"))))
    least = classes.select("c.id", "c.least").distinct()
    per = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))  # of one set: bounded by its size
    enough = per.join(least, "id").where("size(keys) >= least")
    few = enough.select(F.explode(F.expr("slice(keys, 1, cast(size(keys) - least + 1 as int))")).alias("k"), F.col("id").bitwiseAND(~1).alias("id"))
    return cut(few.select("k.key", "id"))


def sharing(keyed: DataFrame) -> DataFrame:
    """(id, rep) stars that join all sets with a common key, for (key, id) rows.

    A task joins the sets of each run of a key and gives out one star per group; the runs at its edges are linked across
    tasks through one row each.
    """

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, edges = _Named(), {}
        for keys, ids, edge in _runs(batches):
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            heads = ids[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
            for a, b in zip(ids[heads != ids].tolist(), heads[heads != ids].tolist()):
                groups.join(a, b)
            if edge:
                edges[int(keys[0])] = int(ids[0])
        pairs = groups.pairs()
        for key, one, other in ((pa.nulls(len(pairs), pa.int64()), [a for a, _ in pairs], [b for _, b in pairs]), (pa.array(list(edges), pa.int64()), list(edges.values()), [None] * len(edges))):
            yield pa.RecordBatch.from_arrays([key, pa.array(one, pa.int64()), pa.array(other, pa.int64())], ["key", "id", "rep"])

    found = cut(_by_key(keyed).mapInArrow(tidied(stars), "key long, id long, rep long"))
    border = found.where("rep is null").groupBy("key").agg(F.min("id").alias("rep"))
    across = found.where("rep is null").select("key", "id").join(border, "key").where("id <> rep").select("id", "rep")
    return found.where("rep is not null").select("id", "rep").unionByName(across)


_BUCKETS = 1 << 19


def wanted_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """`wanted` (doc_id, place, fp, block, chunks, chunk, n) with the shingles, read from the texts again.

    A table of hash buckets, never more than `_BUCKETS` rows however many sets are wanted, is broadcast first, so that
    hardly any other text is shuffled.
    """
    bucket = F.pmod("place", F.lit(_BUCKETS)).alias("bucket")
    few = _rows(docs).withColumn("bucket", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi")
    known = F.coalesce("doc_id", F.lit(0)).alias("known"), F.col("doc_id").isNull().alias("nameless")
    keys = ["place", "known", "nameless"]
    texts = few.select("place", *known, "text").groupBy(keys).agg(F.first("text").alias("text"))
    asked = wanted.select(*known, "place", "fp", "block", "chunks", "chunk", "n")

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, most=SLICE_BYTES // 4):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"), width)]
            yield part.drop_columns(["text"]).append_column("shingles", pa.array(sets, pa.binary()))

    return texts.join(asked, keys).select("fp", "block", "chunks", "chunk", "n", "text").mapInArrow(
        tidied(again), "fp binary, block long, chunks long, chunk long, n long, shingles binary")


# --- T-occurrence search ---------------------------------------------------------


class Index:
    """Inverted lists of one chunk. Set numbers grow with set size, and lists hold them in order.

    `inner`: only sets of the chunk itself will be searched for, so shingles that one of them alone has need no list.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, inner: bool = False):
        self.sets, self.percent = sets, percent
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(len(tokens), 1), bool), tokens[1:] != tokens[:-1])))
        ends = np.append(starts[1:], len(tokens)).astype(int)
        kept = np.flatnonzero(ends - starts > inner)
        self.lists = {int(tokens[starts[i]]): owners[starts[i] : ends[i]].tolist() for i in kept.tolist()}

    def needed(self, a: int, b: int) -> int:
        return -(-self.percent * (a + b) // (100 + self.percent))

    def search(self, query: np.ndarray, skip) -> Iterator[int]:
        """The sets linked with the query, but for those that `skip(i)` says need no comparison."""
        lists = sorted((self.lists[t] for t in query.tolist() if t in self.lists), key=len)
        n, p = len(query), self.percent
        least = -(-p * n // 100)  # a linked set shares this many at least, whatever its size
        if len(lists) < least:
            return
        # As many long lists as the usual rule for DivideSkip gives, but always fewer than the overlap needed.
        aside = min(least - 1, int(least / (0.0085 * np.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        for i, count in self._merged(short, least - aside):
            b = self.sizes[i]
            need = self.needed(n, b)
            if 100 * min(n, b) < p * max(n, b) or skip(i):
                continue
            for left, values in zip(range(len(long) - 1, -1, -1), long):
                if count >= need or count + left + 1 < need:
                    break
                at = bisect_left(values, i)
                count += at < len(values) and values[at] == i
            if count >= need:
                yield i

    @staticmethod
    def _merged(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
        """(set, occurrences) of the sets on at least `least` of the lists."""
        heap = [(values[0], k, 0) for k, values in enumerate(lists)]
        heapq.heapify(heap)
        while len(heap) >= least:
            low, popped = heap[0][0], []
            while heap and heap[0][0] == low:
                popped.append(heapq.heappop(heap))
            if len(popped) >= least:
                yield low, len(popped)
                target = low + 1
            else:  # no set before the least-th list's next one can occur often enough: skip up to there
                while heap and len(popped) < least - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    return
                target = heap[0][0]
            for value, k, at in popped:
                at = at if value >= target else bisect_left(lists[k], target, at + 1)
                if at < len(lists[k]):
                    heapq.heappush(heap, (lists[k][at], k, at))




def _ordered(table: pa.Table) -> tuple[list[bytes], list[np.ndarray]]:
    order = np.lexsort((np.array(table.column("fp").to_pylist(), dtype="S16"), np.asarray(table.column("n")))).tolist()
    fps, raw = table.column("fp").to_pylist(), table.column("shingles").to_pylist()
    return [fps[i] for i in order], [np.frombuffer(raw[i], np.uint64) for i in order]


_MEMBER = "fp binary, rep binary"


def _members(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"fp": pa.array([a for a, _ in pairs], pa.binary()), "rep": pa.array([b for _, b in pairs], pa.binary())})


def _spread(sets: DataFrame, *keys: str) -> DataFrame:
    """Dealt by group to a fixed number of tasks: a search takes long for its bytes, so tasks must not be merged by size."""
    return sets.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _grouped(sets: DataFrame, percent: int) -> DataFrame:
    """(fp, rep): the groups inside each (block, chunk) of `sets`, named by one member."""

    def one(table: pa.Table) -> pa.Table:
        fps, sets_ = _ordered(table)
        index, groups = Index(sets_, percent, inner=True), _Named()
        for q, s in enumerate(sets_):
            for i in index.search(s, lambda i, q=q: i >= q or groups.find(fps[i]) == groups.find(fps[q])):
                groups.join(fps[i], fps[q])
        return _members([(fp, groups.find(fp)) for fp in fps])

    return _spread(sets, "block", "chunk").groupBy("block", "chunk").applyInArrow(tidied_group(one), _MEMBER)


def _links_to(sets: DataFrame, percent: int) -> DataFrame:
    """(fp, rep) links that join the groups `rep` of sets asked for and sets indexed, in each (block, chunk, part)."""

    def one(table: pa.Table) -> pa.Table:
        groups, label = _Named(), dict(zip(table.column("fp").to_pylist(), table.column("rep").to_pylist()))
        fps, sets_ = _ordered(table.filter(pc.invert(table.column("asked"))))
        names, queries = _ordered(table.filter(table.column("asked")))
        index = Index(sets_, percent)
        for a, q in zip(names, queries):
            for i in index.search(q, lambda i, a=a: groups.find(label[fps[i]]) == groups.find(label[a])):
                groups.join(label[fps[i]], label[a])
        return _members(groups.pairs())

    keys = ["block", "chunk", "part"]
    return _spread(sets, *keys).groupBy(*keys).applyInArrow(tidied_group(one), _MEMBER)


def _dealt(sets: DataFrame, salt: int) -> DataFrame:
    """With the number of chunks of the block and the chunk of each set."""
    chunks = sets.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("chunks"))
    return sets.drop("chunks", "chunk").join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(salt)), F.col("chunks")))


def _named(links: DataFrame, name: str = "fp") -> DataFrame:
    found = components(links.select(F.col(name).alias("src"), F.col("rep").alias("dst")))
    return found.select(F.col("node").alias(name), F.col("component").alias("rep"))


def _wide_groups(wide: DataFrame, percent: int) -> DataFrame:
    """(fp, rep) links of the sets in blocks of several chunks."""
    links, level, salt = [cut(_grouped(wide, percent))], wide, 0
    while True:  # one set of each group goes on, to meet those of other chunks
        before = level.count()
        salt += 1
        level = level.join(links[-1].where("fp = rep").select("fp"), "fp", "left_semi")
        level = cut(_dealt(level.select("fp", "block", "n", "shingles"), salt))
        links.append(cut(_grouped(level, percent)))
        if level.where("chunks > 1").isEmpty() or level.count() > 0.9 * before:
            break
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    found = found.where("fp <> rep")
    labelled = cut(wide.join(_named(found), "fp", "left").withColumn("rep", F.coalesce("rep", "fp")))
    sizes = labelled.groupBy("block", "rep").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("block").agg(F.max(F.struct("size", "rep")).alias("most")).select("block", F.col("most.rep").alias("main"))
    outside = labelled.join(largest, "block").where("rep <> main")
    parts = cut(outside.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK_SETS).alias("parts")))
    if parts.isEmpty():
        return found
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["fp", "rep", "block", "n", "shingles"]
    asked = outside.join(parts, "block").select(
        *columns, numbers("chunks").alias("chunk"), F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).alias("part"), F.lit(True).alias("asked"))
    index = labelled.join(parts, "block").select(*columns, "chunk", numbers("parts").alias("part"), F.lit(False).alias("asked"))
    return found.unionByName(_links_to(asked.unionByName(index), percent))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text)."""
    return placed_components(docs, width, percent).drop("place")


def placed_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The same with `place`, a hash of the text, which tells rows with one doc_id apart."""
    rows = cut(sketched(docs, width, percent))
    blocks = cut(_named(sharing(meeting_keys(rows)), "id").withColumnRenamed("rep", "block"))
    # One document stands for each distinct set.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), *_DOC, "n")).alias("first")
    members = rows.where("fp is not null").groupBy("fp", "id").agg(first).join(blocks, "id")
    wanted = cut(_dealt(members.select("fp", "block", *(F.col(f"first.{c}").alias(c) for c in (*_DOC, "n"))), 0))
    links = cut(_grouped(wanted_sets(docs, width, wanted.where("chunks = 1")), percent)).where("fp <> rep")
    if not (wide := wanted.where("chunks > 1")).isEmpty():
        links = links.unionByName(_wide_groups(cut(wanted_sets(docs, width, wide)), percent))
    groups = cut(_named(links))
    labelled = cut(rows.select("doc_id", "place", F.col("n").alias("n_shingles"), "fp").join(groups, "fp", "left").withColumn("rep", F.coalesce("rep", "fp")))
    # Written, so that the join below stands alone and a group with very many rows can be split in it.
    lowest = cut(labelled.where("rep is not null").groupBy("rep").agg(F.min("doc_id").alias("component_id")))
    return labelled.join(lowest, "rep", "left").select(
        "doc_id", "place", "n_shingles", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """The rows of `docs` without near copies: of each group the row with the smallest id, with the same columns.

    Of rows that agree in id and text one stays. A row with a null doc_id goes if its group has a row with one.
    """
    found = placed_components(docs, width, percent).where("n_shingles > 0 and (doc_id <> component_id or doc_id is null and component_id is not null)")
    name, place = free_name(docs.columns, "gone_id"), free_name(docs.columns, "gone_place")
    gone = found.select(F.col("doc_id").alias(name), F.col("place").alias(place)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.xxhash64(F.col("text").cast("string")) == F.col(place))
    return _single(docs).join(gone, same, "left_anti")


def _single(docs: DataFrame) -> DataFrame:
    """One row of each that repeats, told by id and text; untouched where no id and text repeat."""
    place = free_name(docs.columns, "text_place")
    placed = docs.withColumn(place, F.xxhash64(F.col("text").cast("string")))
    again = placed.groupBy("doc_id", place).count().where("count > 1")
    return docs if again.isEmpty() else placed.dropDuplicates(["doc_id", place]).select(docs.columns)
