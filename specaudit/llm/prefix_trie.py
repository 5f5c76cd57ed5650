"""The trie of conversation beginnings, by a splitter-skeleton.

A conversation is its path: one digest per turn (role and text). Sorted by path, the conversations below any node of the
trie are one range, so range-partitioned shards can work on the trie apart, but for the nodes whose range is cut by a
border between shards. Those are exactly the beginnings of the splitter paths: the skeleton, which is small, known before
anything is shuffled, and broadcast as the sorted splitters, whose common lengths are its trie.

A shard streams its sorted conversations with a stack of open nodes. When a node closes, all its conversations have been
seen, and it is finished there, unless it is in the skeleton: then the shard gives a partial row, and an aggregate over
the partial rows of all shards finishes it. What counts once per skeleton node, not once per shard, is counted by one
shard that all can tell: the one of the first splitter that begins with the node (its own text is not saved the first time,
its parent has one more child), or the one of the last such splitter (which sees all its children, and so knows whether it
is a leaf).

A node is named by its smallest conversation and its depth. A parent is known only when it closes, so an only child waits
on the stack for it, and the children of branching nodes find theirs by a join on a running digest of the path.

Scale: texts never leave the scan; a turn is 16 bytes and a length. A task holds one path, the stack along it and one only
child per open node. Splitters are (path, conv_id) pairs, so a large group of equal conversations is cut too. They come
from a sample of `SAMPLE_PER_SHARD` paths a shard, chosen by hash, of at most `SPLITTER_TURNS` turns each: the broadcast is
bounded by shards * SPLITTER_TURNS * 16 bytes; which paths are splitters does not change the result. A conversation's
path is one value, so a conversation may have some hundred million turns. The ids of those that end at one skeleton
node are hashed by one task, in order, as their digest is defined, but never held.

Edge cases: a null role or text is empty. Turns are ordered by turn (nulls first); rows that share a turn by the digest of
role and text, so repeated rows are turns of their own. Rows with a null conv_id belong to no conversation and are left
out. Negative ids have the sign of the remainder that SQL gives. No conversations give no nodes, not even a root. Other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.session import cut

WIDTH = 16  # bytes of a turn's digest
SAMPLE_PER_SHARD = 32
SPLITTER_TURNS = 1024
IDS = 1000  # ids in one row of those that end at a skeleton node
ROWS_OUT = 2000


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (digest, bytes)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).where("conv_id is not null")
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """Each conversation with its first turns taken from the first conversation of its group, as a checksum of its id says."""
    asked = own.withColumns({"donor": F.expr(f"conv_id - conv_id % {group}"), "h": (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (most + 1)).cast("int")})
    given = own.where(f"conv_id % {group} = 0").select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most).alias("given"))
    begin = F.when(F.col("given").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("given", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return asked.join(given, "donor", "left").select("conv_id", F.concat(begin, rest).alias("turns"))


# --- splitters -------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    if a == b:
        return len(a) // WIDTH
    n, most = 0, min(len(a), len(b)) // WIDTH
    while n < most and a[n * WIDTH : (n + 1) * WIDTH] == b[n * WIDTH : (n + 1) * WIDTH]:
        n += 1
    return n


def splitters(rows: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 (path, conv_id) pairs that cut the turns of a sample into equal parts."""
    sample = rows.where(F.octet_length("path") <= WIDTH * SPLITTER_TURNS).select("path", "conv_id")
    drawn = sorted((bytes(r.path), r.conv_id) for r in sample.orderBy(F.xxhash64("path", "conv_id"), "conv_id").limit(SAMPLE_PER_SHARD * shards).collect())
    weight, total, out = 0, sum(1 + len(p) // WIDTH for p, _ in drawn), []
    for path, conv in drawn:
        if weight * shards >= (len(out) + 1) * total:
            out.append((path, conv))
        weight += 1 + len(path) // WIDTH
    return out


class Borders:
    """What a shard has to know of the skeleton: the splitters beside it, and how far they agree."""

    def __init__(self, cuts: list[tuple[bytes, int]], shard: int):
        self.left = cuts[shard - 1][0] if shard else b""
        self.right = cuts[shard][0] if shard < len(cuts) else b""
        before = cuts[shard - 2][0] if shard > 1 else None
        self.first = 0 if before is None else _common(before, self.left) + 1  # least depth that this shard counts
        self.last = _common(self.left, self.right) + 1 if shard < len(cuts) else 0
        self.splits = shard > 0

    def depth(self, path: bytes) -> int:
        """The deepest skeleton node on a path of this shard."""
        return max(_common(path, self.left), _common(path, self.right))

    def counts_own(self, path: bytes, depth: int) -> bool:
        """Whether what holds once for the node at this depth of the path is counted here."""
        return self.splits and depth >= max(self.first, 1) and _common(path, self.left) >= depth

    def sees_all_children(self, path: bytes, depth: int) -> bool:
        return self.splits and depth >= self.last and _common(path, self.left) >= depth


# --- one shard -------------------------------------------------------------------


class Node:
    __slots__ = ("key", "low", "n", "kids", "seen", "leaves", "saved", "bytes", "ends", "ids", "only", "skeleton")

    def __init__(self, key: bytes, size: int, skeleton: bool):
        self.key, self.bytes, self.skeleton = key, size, skeleton
        self.low: int | None = None
        self.n = self.kids = self.leaves = self.saved = 0
        self.seen = False  # a child of any kind
        self.ends = sha256()
        self.ids: list[int] = []
        self.only: tuple | None = None


DONE, ASKING, PARTIAL, ENDS = range(4)
_KINDS = {"kind": pa.int32(), "key": pa.binary(), "parent": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string(), "shard": pa.int64(), "part": pa.int64()}
_FOUND = "kind int, key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, shard long, part long"
ROOT = bytes(WIDTH)


def _merge(parent: Node, low: int, n: int, leaves: int, saved: int) -> None:
    parent.low = low if parent.low is None else min(parent.low, low)
    parent.n, parent.leaves, parent.saved, parent.seen = parent.n + n, parent.leaves + leaves, parent.saved + saved, True


class Shard:
    """The trie of one sorted range of conversations."""

    def __init__(self, cuts: list[tuple[bytes, int]], shard: int):
        self.borders, self.shard = Borders(cuts, shard), shard
        self.stack, self.path, self.parts = [Node(ROOT, 0, True)], b"", 0

    def rows(self, conversations: Iterable[tuple[int, bytes, list[int]]]) -> Iterator[tuple]:
        for conv, path, sizes in conversations:
            same = _common(path, self.path)
            while len(self.stack) - 1 > same:
                yield from self._close()
            self.path = path
            skeleton = self.borders.depth(path)
            for d in range(same, len(path) // WIDTH):
                key = blake2b(self.stack[-1].key + path[d * WIDTH : (d + 1) * WIDTH], digest_size=WIDTH).digest()
                self.stack.append(Node(key, sizes[d], d + 1 <= skeleton))
            node = self.stack[-1]
            node.n += 1
            node.low = conv if node.low is None else min(node.low, conv)
            if node.skeleton:
                node.ids.append(conv)
                if len(node.ids) == IDS:
                    yield self._ids(node)
            else:
                node.ends.update((f",{conv}" if node.ids else str(conv)).encode())
                node.ids = [conv]
        while self.stack:
            yield from self._close()

    def _ids(self, node: Node) -> tuple:
        self.parts += 1
        text, node.ids = ",".join(map(str, node.ids)), []
        return ENDS, node.key, None, *[None] * 7, text, self.shard, self.parts

    def _close(self) -> Iterator[tuple]:
        depth = len(self.stack) - 1
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        if node.skeleton:
            if node.ids:
                yield self._ids(node)
            own = self.borders.counts_own(self.path, depth)
            saved = node.saved + (node.n - own) * node.bytes
            leaves = node.leaves + (not node.seen and depth > 0 and self.borders.sees_all_children(self.path, depth))
            yield PARTIAL, node.key, parent.key if parent else None, node.low, depth, None, node.n, node.kids, leaves, saved, None, self.shard, None
            if parent:
                parent.kids += own
                _merge(parent, node.low, node.n, leaves, saved)
            return
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.bytes
        if node.only:
            yield DONE, *node.only[:4], node.low, *node.only[4:]
        row = (node.key if node.kids > 1 else None, parent.key, node.low, depth, node.n, node.kids, leaves, saved, node.ends.hexdigest(), self.shard, None)
        if not parent.skeleton and not parent.kids:
            parent.only = row
        else:
            if parent.only:
                yield ASKING, *parent.only[:4], None, *parent.only[4:]
                parent.only = None
            yield ASKING, *row[:4], None, *row[4:]
        parent.kids += 1
        _merge(parent, node.low, node.n, leaves, saved)


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS.values())], list(_KINDS))
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS.values())], list(_KINDS))


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _ends(pieces: DataFrame) -> DataFrame:
    """(key, ends): the digest of the ids that end at each skeleton node, streamed in order."""

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groupby(_lines(batches), key=itemgetter(0)):
            hashed = sha256(next(group)[1].encode())
            for _, text in group:
                hashed.update(f",{text}".encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": [hashed.hexdigest()]})

    ordered = pieces.repartition("key").sortWithinPartitions("key", "shard", "part")
    return ordered.select("key", F.col("ends").alias("text")).mapInArrow(digests, "key binary, ends string")


def prefix_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of (conv_id, turns)."""
    spark = conversations.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = cut(conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes")))
    known = spark.sparkContext.broadcast(splitters(rows, shards))

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(known.value, x) for x in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield batch.append_column("shard", pa.array(at, pa.int64()))

    def shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in groupby(_lines(batches), key=itemgetter(0)):
            yield from _batches(Shard(known.value, number).rows(line[1:] for line in group))

    placed = rows.mapInArrow(dealt, "conv_id long, path binary, sizes array<long>, shard long")
    ordered = placed.repartition("shard").sortWithinPartitions("shard", "path", "conv_id").select("shard", "conv_id", "path", "sizes")
    found = cut(ordered.mapInArrow(shard, _FOUND))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    partial = found.where(F.col("kind") == PARTIAL).groupBy("key").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums)
    skeleton = partial.withColumn("n_leaves", F.when((F.col("depth") == 0) & (F.col("n_children") == 0), 1).otherwise(F.col("n_leaves")))
    ends = F.coalesce("ends", F.lit(sha256(b"").hexdigest())).alias("ends")
    skeleton = cut(skeleton.join(_ends(found.where(F.col("kind") == ENDS)), "key", "left").select(*skeleton.columns, ends))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    asking = found.where(F.col("kind") == ASKING).select("parent", *columns).unionByName(skeleton.select("parent", *columns))
    branching = found.where((F.col("kind") < PARTIAL) & F.col("key").isNotNull()).select("key", "conv_id").unionByName(skeleton.select("key", "conv_id"))
    answered = asking.join(branching.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left").drop("parent")
    nodes = found.where(F.col("kind") == DONE).select(*columns, "parent_conv_id").unionByName(answered)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def oracle_sql() -> str:
    """The trie of the rebuilt `conversations`, from all beginnings of all of them."""
    digest = "md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    crc = f"list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: {step}))"
    return f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {digest}) AS k, {digest} AS g, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, xor({crc}, 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT i.conv_id AS c, 0 AS part, k, g, bytes FROM ids i JOIN t ON t.conv_id = i.conv_id - i.conv_id % 5 WHERE k <= h UNION ALL SELECT i.conv_id, 1, k, g, bytes FROM ids i JOIN t ON t.conv_id = i.conv_id WHERE k > h),
d AS (SELECT c, row_number() OVER w AS depth, bytes, md5(string_agg(g, '') OVER w) AS p FROM r WINDOW w AS (PARTITION BY c ORDER BY part, k ROWS UNBOUNDED PRECEDING)),
a AS (SELECT c, depth, bytes, p FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
n AS (SELECT depth, p, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM a GROUP BY depth, p),
-- The ancestors of a node are the beginnings of its smallest conversation.
up AS (SELECT n.depth, n.p, n.conv_id, n.n_convs, n.bytes, a.depth AS depth2, a.p AS p2 FROM n JOIN a ON a.c = n.conv_id AND a.depth <= n.depth),
kids AS (SELECT depth2 AS depth, p2 AS p, count(*) AS n_children FROM up WHERE depth2 = depth - 1 GROUP BY 1, 2),
leaf AS (SELECT n.depth, n.p FROM n LEFT JOIN kids USING (depth, p) WHERE n_children IS NULL),
below AS (SELECT depth2 AS depth, p2 AS p, CAST(count(leaf.p) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM up LEFT JOIN leaf ON leaf.depth = up.depth AND leaf.p = up.p GROUP BY 1, 2),
lengths AS (SELECT c, max(depth) AS depth FROM a GROUP BY c),
ends AS (SELECT a.depth, a.p, sha256(string_agg(CAST(a.c AS VARCHAR), ',' ORDER BY a.c)) AS ends FROM a JOIN lengths USING (c, depth) GROUP BY 1, 2)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN up ON up.depth = n.depth AND up.p = n.p AND depth2 = n.depth - 1 LEFT JOIN n m ON m.depth = up.depth2 AND m.p = up.p2
LEFT JOIN kids ON kids.depth = n.depth AND kids.p = n.p JOIN below ON below.depth = n.depth AND below.p = n.p LEFT JOIN ends ON ends.depth = n.depth AND ends.p = n.p
"""
