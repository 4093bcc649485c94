"""Prefix trie of conversations from padded turn-id matrices.

Every (role, text) becomes a 128-bit turn id, every conversation a row of ids.
Rows are range-partitioned and sorted by (ids, conv_id). A task takes them in
blocks of bounded size as padded matrices: numpy lexsort, marks where a column
differs from the row before, OR-accumulated over the columns, so that a mark at
column d says that a node of depth d starts; reduceat over the marks gives each
depth's counts. Only the nodes that hold a block's first or last row may go on in
a neighbour. They lie on two paths of the block, and a stack joins the paths of
consecutive blocks (within the task) and then of consecutive partitions (one pass
over two paths per partition, so bounded by partitions times depth). Other nodes
refer to such a parent by (partition, number), and a join brings its id.

The digest of the conversations that end at a node that spans blocks is fed from
one chunk of ids per block, in order, without holding them together.

Null role and text count as empty; turns are ordered by turn, null first, equal
turns by their ids. Rows without a conv_id belong to no conversation and take no
part. Repeated rows are turns of their own. A conversation travels as one row of
ids, 24 bytes a turn, so one of a million turns fits a task; texts do not travel.
Extra columns are not read. No conversations give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import stored, table

CELLS = 2_000_000
PAD = np.iinfo(np.int64).min
NOBODY = hashlib.sha256(b"").hexdigest()
CLOSED, OPEN, CHUNK, ALIAS = range(4)

FIELDS = {"kind": pa.int32(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
          "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
          "part": pa.int32(), "ref": pa.int64(), "parent_part": pa.int32(), "parent_ref": pa.int64(), "a": pa.int64(),
          "b": pa.int64(), "n_bytes": pa.int64(), "n_ends": pa.int64(), "first": pa.bool_(), "last": pa.bool_(),
          "number": pa.int64(), "chunk": pa.string()}
SCHEMA = pa.schema(list(FIELDS.items()))
SPARK_NAMES = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean"}
DDL = ", ".join(f"{name} {SPARK_NAMES[kind]}" for name, kind in FIELDS.items())


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (a, b, n_bytes)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("turn"), text, role).alias("b"),
                    F.octet_length(text).cast("bigint").alias("n_bytes"))
    return (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"),
                                                                   t["n_bytes"].alias("n_bytes"))).alias("turns")))


class Node:
    """A node that may go on in the next block; sums are over what is closed below it."""
    __slots__ = ("turn", "depth", "n", "conv", "n_bytes", "children", "leaves", "saved", "ends", "refs", "first")

    def __init__(self, turn, depth, n, conv, n_bytes, children, leaves, saved, ends, refs=(), first=False):
        self.turn, self.depth, self.n, self.conv, self.n_bytes = turn, depth, n, conv, n_bytes
        self.children, self.leaves, self.saved, self.ends = children, leaves, saved, ends
        self.refs, self.first = list(refs), first

    def absorb(self, other: Node) -> None:
        """The same node in the next block."""
        self.n, self.conv, self.ends = self.n + other.n, min(self.conv, other.conv), self.ends + other.ends
        self.children, self.leaves = self.children + other.children, self.leaves + other.leaves
        self.saved, self.refs = self.saved + other.saved, self.refs + other.refs

    def close(self, parent: Node | None) -> None:
        """Nothing more comes below: own share added, and passed on to the parent."""
        self.leaves += self.children == 0
        self.saved += (self.n - 1) * self.n_bytes
        if parent:
            parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + self.leaves, parent.saved + self.saved


class Stack:
    """Joins the first and last paths of consecutive blocks; ``done(node, parent)``
    is called for each node once no later block can hold it."""

    def __init__(self, done: Callable[[Node, Node | None], None]):
        self.nodes: list[Node] = []
        self.done = done

    def cut(self, depth: int) -> None:
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.done(node, self.nodes[-1] if self.nodes else None)

    def add(self, first: list[Node], last: list[Node]) -> tuple[list[Node], list[Node]]:
        """Take one block's paths (from the root; they share what both hold).
        Returns the nodes that now stand for them."""
        same = 0
        while same < min(len(self.nodes), len(first)) and self.nodes[same].turn == first[same].turn:
            same += 1
        self.cut(same)
        for old, new in zip(self.nodes, first):
            old.absorb(new)
        self.nodes += first[same:]
        first_now = list(self.nodes)
        both = sum(x is y for x, y in zip(first, last))
        self.cut(both)
        self.nodes += last[both:]
        return first_now, list(self.nodes)


def _row(kind: int, node: Node, parent: Node | None = None, **more) -> dict:
    part, ref = node.refs[0]
    up = parent.refs[0] if parent else (None, None)
    return {"kind": kind, "conv_id": node.conv, "depth": node.depth, "n_convs": node.n, "n_children": node.children,
            "n_leaves": node.leaves, "saved_tokens": node.saved, "n_ends": node.ends,
            "ends_sha256": None if node.ends else NOBODY, "part": part, "ref": ref, "parent_part": up[0], "parent_ref": up[1], **more}


class Block:
    """The nodes of a run of rows: ``conv`` ids, turn ids ``a`` and ``b`` and turn
    lengths ``n_bytes`` as padded matrices, ``sizes`` turns each."""

    def __init__(self, conv: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, n_bytes: np.ndarray):
        width = a.shape[1]
        order = np.lexsort([conv, *(m[:, d] for d in range(width - 1, -1, -1) for m in (b, a))])
        self.conv, self.sizes, a, b, n_bytes = conv[order], sizes[order], a[order], b[order], n_bytes[order]
        n = len(conv)
        live = np.arange(width + 1) <= self.sizes[:, None]
        change = np.zeros((n, width + 1), dtype=bool)
        change[0] = True
        change[1:, 1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (live[1:, 1:] != live[:-1, 1:])
        np.logical_or.accumulate(change, axis=1, out=change)
        kids, leaves, saved = (np.zeros(n, dtype=np.int64) for _ in range(3))
        self.depths: list[dict] = []
        for d in range(width, -1, -1):
            heads = np.flatnonzero(change[:, d])
            at = {"heads": heads, "n": np.diff(np.append(heads, n)), "conv": np.minimum.reduceat(self.conv, heads),
                  "children": np.add.reduceat(kids, heads), "leaves": np.add.reduceat(leaves, heads),
                  "saved": np.add.reduceat(saved, heads), "live": live[heads, d],
                  "ends": np.add.reduceat((self.sizes == d).astype(np.int64), heads),
                  "n_bytes": n_bytes[heads, d - 1] if d else np.zeros(len(heads), dtype=np.int64)}
            at["open"] = at["live"].copy()
            at["open"][1:-1] = False
            closed = at["live"] & ~at["open"]
            childless = (closed & (at["children"] == 0)).astype(np.int64)
            own = np.where(closed, (at["n"] - 1) * at["n_bytes"], 0)
            at["leaves"], at["saved"] = at["leaves"] + childless, at["saved"] + own
            leaves[heads] += childless
            saved[heads] += own
            for i in {0, len(heads) - 1}:
                if at["open"][i]:  # an open node carries its sums itself
                    rows = slice(heads[i], heads[i] + at["n"][i])
                    leaves[rows] = saved[rows] = 0
            kids[:] = 0
            kids[heads[closed]] = 1
            at["closed"] = closed
            self.depths.append(at)
        self.depths.reverse()
        self.a, self.b = a, b

    def _node(self, d: int, i: int) -> Node:
        at = self.depths[d]
        head = at["heads"][i]
        turn = (int(self.a[head, d - 1]), int(self.b[head, d - 1])) if d else None
        return Node(turn, d, *(int(at[c][i]) for c in ("n", "conv", "n_bytes", "children", "leaves", "saved", "ends")))

    def paths(self) -> tuple[list[Node], list[Node]]:
        """The nodes that hold the first row, and those that hold the last."""
        first = [self._node(d, 0) for d in range(int(self.sizes[0]) + 1)]
        last = [first[d] if len(self.depths[d]["heads"]) == 1 else self._node(d, -1) for d in range(int(self.sizes[-1]) + 1)]
        return first, last

    def ended(self, d: int, i: int) -> str:
        """The ids of the conversations that end at a node, comma-joined."""
        head = self.depths[d]["heads"][i]
        return ",".join(map(str, self.conv[head:head + self.depths[d]["ends"][i]].tolist()))

    def closed_rows(self, part: int, first: list[Node], last: list[Node]) -> Iterator[pa.RecordBatch]:
        """The finished nodes; those under a node of a path refer to it."""
        for d in range(1, len(self.depths)):
            at, up = self.depths[d], self.depths[d - 1]
            rows = np.flatnonzero(at["closed"])
            if not len(rows):
                continue
            parent = np.searchsorted(up["heads"], at["heads"][rows], side="right") - 1
            under = up["open"][parent]
            refs = np.where(parent == 0, first[d - 1].refs[0][1] if d <= len(first) else -1,
                            last[d - 1].refs[0][1] if d <= len(last) else -1)
            shas = [hashlib.sha256(self.ended(d, i).encode()).hexdigest() if at["ends"][i] else NOBODY for i in rows.tolist()]
            n = len(rows)
            full = {"kind": pa.array(np.full(n, CLOSED, dtype=np.int32)), "depth": pa.array(np.full(n, d, dtype=np.int64)),
                    "part": pa.array(np.full(n, part, dtype=np.int32)), "parent_part": pa.array(np.full(n, part, dtype=np.int32)),
                    "parent_conv_id": pa.array(up["conv"][parent], mask=under), "parent_ref": pa.array(refs, pa.int64(), mask=~under),
                    "ends_sha256": pa.array(shas), "conv_id": pa.array(at["conv"][rows]), "n_convs": pa.array(at["n"][rows]),
                    "n_children": pa.array(at["children"][rows]), "n_leaves": pa.array(at["leaves"][rows]),
                    "saved_tokens": pa.array(at["saved"][rows]), "n_ends": pa.array(at["ends"][rows])}
            yield pa.RecordBatch.from_arrays([full[c] if c in full else pa.nulls(n, kind) for c, kind in FIELDS.items()], schema=SCHEMA)


def _blocks(batch: pa.RecordBatch, cells: int) -> Iterator[Block]:
    """A batch's rows in blocks of at most ``cells`` matrix cells (one row at least)."""
    conv, lists = batch.column("conv_id").to_numpy(), batch.column("turns")
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.flatten()
    values = [flat.field(c).to_numpy() for c in ("a", "b", "n_bytes")]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    start = 0
    while start < len(conv):
        stop, widest = start, 0
        while stop < len(conv) and (stop == start or max(widest, sizes[stop]) * (stop + 1 - start) <= cells):
            widest, stop = max(widest, int(sizes[stop])), stop + 1
        size = sizes[start:stop]
        places = np.arange(widest) < size[:, None]
        matrices = []
        for v, pad in zip(values, (PAD, PAD, 0)):
            m = np.full((stop - start, widest), pad, dtype=np.int64)
            m[places] = v[ends[start]:ends[stop]]
            matrices.append(m)
        yield Block(conv[start:stop], size, *matrices)
        start = stop


def _shard(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """One sorted partition: closed nodes, nodes left open at its two ends, chunks of ids."""
    out: list[dict] = []
    part, numbers = None, 0

    def done(node: Node, parent: Node | None) -> None:
        if node.first:  # may have begun in the partition before
            out.append(_row(OPEN, node, parent, a=node.turn and node.turn[0], b=node.turn and node.turn[1], n_bytes=node.n_bytes,
                            first=True, last=False))
        else:
            node.close(parent)
            out.append(_row(CLOSED, node, parent))

    stack, number = Stack(done), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py() if part is None else part
        for block in _blocks(batch, cells):
            first, last = block.paths()
            marks = [(node, block.ended(d, i)) for path, i in ((first, 0), (last, -1)) for d, node in enumerate(path)
                     if node.ends and (i == 0 or d >= len(first) or node is not first[d])]
            for node in {id(n): n for n in [*first, *last]}.values():
                node.refs = [(part, numbers)]
                numbers += 1
            for node in first:
                node.first = number == 0
            now_first, now_last = stack.add(first, last)
            stands = {id(node): now for node, now in zip([*first, *last], [*now_first, *now_last], strict=True)}
            for node, ids in marks:
                at = stands[id(node)].refs[0]
                out.append({"kind": CHUNK, "part": part, "ref": at[1], "number": number, "chunk": ids})
            yield from block.closed_rows(part, now_first, now_last)
            number += 1
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
                out.clear()
    for node, parent in zip(reversed(stack.nodes), [*reversed(stack.nodes[:-1]), None]):
        out.append(_row(OPEN, node, parent, a=node.turn and node.turn[0], b=node.turn and node.turn[1], n_bytes=node.n_bytes,
                        first=node.first, last=True))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All partitions' open nodes, sorted by partition and depth: finished nodes,
    and an alias for each partition's number of them."""
    out: list[dict] = []

    def done(node: Node, parent: Node | None) -> None:
        node.close(parent)
        out.append(_row(CLOSED, node, parent))
        out.extend(_row(ALIAS, node) | {"part": part, "ref": ref} for part, ref in node.refs[1:])

    stack, held, part = Stack(done), [], None

    def flush() -> None:
        nodes = [(Node((r["a"], r["b"]) if r["depth"] else None, *(r[c] for c in (
            "depth", "n_convs", "conv_id", "n_bytes", "n_children", "n_leaves", "saved_tokens", "n_ends")), refs=[(r["part"], r["ref"])]),
            r["first"], r["last"]) for r in held]
        stack.add([n for n, first, _ in nodes if first], [n for n, _, last in nodes if last])
        held.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["part"] != part:
                flush()
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
                    out.clear()
            part = row["part"]
            held.append(row)
    if held:
        flush()
    stack.cut(0)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come in order, one after another."""
    out, node, digest = [], None, None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["conv_id"], row["depth"]) != node:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (row["conv_id"], row["depth"]), hashlib.sha256(row["chunk"].encode())
            else:
                digest.update(b"," + row["chunk"].encode())
    if node:
        out.append((*node, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["conv_id", "depth", "sha"])


def nodes(conversations: DataFrame, cells: int = CELLS) -> DataFrame:
    """The trie's nodes of ``conversations`` (conv_id, turns as (a, b, n_bytes)):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    ids = F.transform("turns", lambda t: F.struct(t["a"], t["b"]))
    rows = (conversations.select("conv_id", "turns").repartitionByRange(ids, F.col("conv_id"))
            .withColumn("part", F.spark_partition_id()).sortWithinPartitions(ids, "conv_id"))
    made = stored(rows.mapInArrow(lambda batches: _shard(batches, cells), DDL), "trie-nodes")
    ends = made.where(F.col("kind") == OPEN).repartition(1).sortWithinPartitions("part", "depth", F.desc("first"))
    made = made.where(F.col("kind") != OPEN).unionByName(stored(ends.mapInArrow(_joined, DDL), "trie-joined"))
    known = made.where(F.col("kind").isin(CLOSED, ALIAS) & F.col("ref").isNotNull()) \
        .select("part", "ref", "conv_id", F.col("depth"))
    closed = made.where(F.col("kind") == CLOSED)
    up = known.select(F.col("part").alias("parent_part"), F.col("ref").alias("parent_ref"), F.col("conv_id").alias("up"))
    placed = (closed.where("parent_ref IS NULL")
              .unionByName(closed.where("parent_ref IS NOT NULL").join(up, ["parent_part", "parent_ref"])
                           .withColumn("parent_conv_id", F.col("up")).drop("up")))
    chunks = (made.where(F.col("kind") == CHUNK).select("part", "ref", "number", "chunk").join(known, ["part", "ref"])
              .repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part", "number")
              .select("conv_id", "depth", "chunk").mapInArrow(_digests, "conv_id bigint, depth bigint, sha string"))
    hashed = (placed.where("ends_sha256 IS NULL").join(chunks, ["conv_id", "depth"]).withColumn("ends_sha256", F.col("sha")).drop("sha"))
    return (placed.where("ends_sha256 IS NOT NULL").unionByName(hashed)
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


GROUP, HEAD = 5, 9


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The registered query's conversations: every fifth one's first turns (a number
    of them drawn from the id) in front of the others' own later turns."""
    own = turn_ids(conversations).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int"))
    own = stored(own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP), "trie-turns")
    heads = own.where("conv_id = base").select("base", F.slice("turns", 1, HEAD).alias("head"))
    return own.join(heads, "base", "left").select(
        "conv_id", F.concat(F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.expr("slice(head, 1, h)")),
                            F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")).alias("turns"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(rebuilt(table(spark, sf_dir, "conversations")))


ORACLE = """
WITH RECURSIVE own AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc(conv_id, s, i, c) AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM own
  UNION ALL
  SELECT conv_id, s, i + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x
        FROM crc WHERE i < 8 * length(s))
), h AS (
  SELECT conv_id, xor(c, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i = 8 * length(s)
), built AS (
  SELECT o.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), coalesce(list_slice(o.turns, h.h + 1, len(o.turns)), [])) AS turns
  FROM own o JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), pre AS (
  SELECT conv_id, len(turns) AS size, d, list_slice(turns, 1, d) AS path
  FROM built, range(0, (SELECT max(len(turns)) + 1 FROM built)) AS r(d) WHERE d <= len(turns)
), node AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends,
         CASE WHEN d = 0 THEN 0 ELSE strlen(path[d].text) END AS n_bytes
  FROM pre GROUP BY path, d
), kids AS (
  SELECT list_slice(path, 1, depth - 1) AS path, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL
), full_node AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM node n LEFT JOIN kids k ON k.path = n.path AND k.depth = n.depth
), sums AS (
  SELECT list_slice(path, 1, e) AS path, e AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
         sum((n_convs - 1) * n_bytes) AS saved
  FROM full_node, range(0, (SELECT max(depth) + 1 FROM node)) AS r(e) WHERE e <= depth GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_node n JOIN sums s ON s.path = n.path AND s.depth = n.depth
LEFT JOIN node p ON n.depth > 0 AND p.path = list_slice(n.path, 1, n.depth - 1) AND p.depth = n.depth - 1
"""
