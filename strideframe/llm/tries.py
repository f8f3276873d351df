"""Conversation prefix trie from sorted neighbours.

Conversations are sequences of turns; a turn is known by 128 bits of its role and text.  Each distinct sequence of
first turns is a node, the empty one the root.

1. Conversations are range-partitioned by their turn sequences, then ids, so that equal sequences lie together and
   a sequence that a third of all conversations have is still dealt to many tasks.  A sorted part is a block.
2. Neighbours' common prefix lengths are the edges of the block's rows.  Union-find takes them in descending depth:
   each merge makes a branching node of the two components' top nodes, or widens one.  Nodes with one child
   lie on the chains between these nodes and are written out from them.
3. Nodes that a block shares with a neighbour are the prefixes of its first or last row up to the common length with the
   row across the boundary.  A block's forest is contracted to these: what hangs below them complete is summed
   into them.  Spark merges them across all boundaries by node and adds each one's sums to its ancestors.
4. Each block, told the merged nodes' smallest ids, writes its complete nodes.

A conversation is held as 16 bytes a turn, a block's conversations in one task; the ids that end in a shared node
stream through one digest, block by block.

A null conv_id belongs to no conversation, null role or text is empty.  Turns are ordered by number, null first, those of
equal number by their 128 bits; repeated rows are repeated turns.  An empty table has no nodes, not even a root.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.chunks import dump, parsed
from strideframe.llm.exchange import rows
from strideframe.llm.store import ship, stage

#: Bytes that name a turn, and of turn names in a block on average.
KEY, BLOCK_BYTES = 16, 4 << 20
#: Conversations share their first turns by hundreds, up to five turns each.
FAMILY, HEADS = 100, 6

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SHARED = "block long, node binary, depth long, size long, n long, least long, kids long, leaves long, saved long, ends binary, path array<binary>, side int"


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (array of key, 32 hexadecimal digits, and size, the text's code points) of each conversation."""
    ship(conversations.sparkSession)
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    own = conversations.select(F.col(f"`{id_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                               key.alias("key"), F.length(text).cast("long").alias("size")).where("conv_id IS NOT NULL")
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "key", "size")))
    return own.groupBy("conv_id").agg(F.transform(sorted_turns, lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def with_family_heads(found: DataFrame) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % 100, its own behind its first h follow;
    h is the CRC of c's digits modulo 6."""
    heads = found.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("heads"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    taken = F.coalesce(F.slice("heads", F.lit(1), h), F.slice("turns", 1, 0))
    return found.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left") \
                .select("conv_id", F.concat(taken, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _blocks(found: DataFrame, block_bytes: int) -> DataFrame:
    """block (from 0, in the order of sequences), held (Arrow: conv_id, keys, sizes), first, last."""
    packed = stage(found.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("keys"),
                                F.transform("turns", lambda t: t["size"]).alias("sizes")), "sequences")
    total = packed.agg(F.sum(F.length("keys") + 24)).first()[0] or 0
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / block_bytes))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = whole.column("keys")
            yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "held": pa.array([dump(whole)], pa.binary()),
                                   "first": keys.slice(0, 1).cast(pa.binary()), "last": keys.slice(len(keys) - 1, 1).cast(pa.binary())})

    dealt = packed.repartitionByRange(parts, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    blocks = stage(dealt.mapInArrow(gather, "part long, held binary, first binary, last binary"), "trie-blocks")
    numbers = blocks.select("part", (F.row_number().over(Window.orderBy("part")) - 1).cast("long").alias("block"))  # one number a part
    return blocks.join(numbers, "part").drop("part")


def common(a: bytes, b: bytes) -> int:
    """The number of first turns that two sequences share."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:KEY * mid] == b[:KEY * mid] else (low, mid - 1)
    return low


def _with_shared_depths(blocks: DataFrame) -> DataFrame:
    """``blocks`` with left and right: the turns that the first row shares with the row before, the last with the row behind."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            yield pa.record_batch({"block": pa.array([row["block"]], pa.int64()), "depth": pa.array([common(row["last"], row["first"])], pa.int64())})

    edges = blocks.select("block", "last").join(blocks.select((F.col("block") - 1).alias("block"), "first"), "block")
    depths = stage(edges.mapInArrow(measure, "block long, depth long"), "boundaries")
    return blocks.select("block", "held") \
        .join(depths.select((F.col("block") + 1).alias("block"), F.col("depth").alias("left")), "block", "left") \
        .join(depths.select("block", F.col("depth").alias("right")), "block", "left").fillna(0, ["left", "right"])


@dataclass
class Forest:
    """The branching and end nodes of a block's trie: depth, first row, rows, smallest id, parent and children."""
    depth: list[int]
    row: list[int]
    count: list[int]
    least: list[int]
    parent: list[int]
    kids: list[list[int]]
    root: int


def forest(lengths: list[int], shared: list[int], ids: list[int]) -> Forest:
    """The forest of sorted rows with ``lengths`` turns, of which neighbours share the first ``shared``."""
    n = len(lengths)
    depth, row, count, least = list(lengths), list(range(n)), [1] * n, list(ids)
    parent, kids, top, set_of = [-1] * n, [[] for _ in range(n)], list(range(n)), list(range(n))

    def find(x: int) -> int:
        while set_of[x] != x:
            set_of[x] = set_of[set_of[x]]
            x = set_of[x]
        return x

    def above(v: int, d: int) -> int:
        """A node at depth d over the top node v."""
        if depth[v] == d:
            return v
        depth.append(d), row.append(row[v]), count.append(count[v]), least.append(least[v])
        parent.append(-1), kids.append([v])
        parent[v] = len(depth) - 1
        return parent[v]

    # edges of equal depth go from left to right, so the right component's top lies deeper, but for equal rows
    for e in np.argsort(-np.asarray(shared, np.int64), kind="stable").tolist():
        x, y = find(e), find(e + 1)
        a, b = above(top[x], shared[e]), top[y]
        count[a] += count[b]
        least[a] = min(least[a], least[b])
        if depth[b] > shared[e]:
            parent[b] = a
            kids[a].append(b)
        set_of[y], top[x] = x, a
    return Forest(depth, row, count, least, parent, kids, above(top[find(0)], 0))


class _Block:
    """A block's forest, and which of its nodes lie on its boundaries."""

    def __init__(self, held: bytes, left: int, right: int):
        part = parsed(held)
        self.ids = part.column("conv_id").to_pylist()
        self.keys = part.column("keys").to_pylist()
        sizes = part.column("sizes")
        self.start = sizes.offsets.to_numpy().tolist()
        self.sums = np.concatenate([[0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False), dtype=np.int64)]).tolist()
        self.n, self.left, self.right = len(self.ids), left, right
        self.lengths = [len(k) // KEY for k in self.keys]
        self.f = f = forest(self.lengths, [common(a, b) for a, b in zip(self.keys, self.keys[1:])], self.ids)
        # leaves and savings strictly below each node, as if the block were all
        self.leaves, self.below = [0] * len(f.depth), [0] * len(f.depth)
        for v in self.deepest_first():
            for c in f.kids[v]:
                self.leaves[v] += self.leaves[c]
                self.below[v] += self.saved(c, f.depth[v] + 1)
            self.leaves[v] = self.leaves[v] or 1

    def deepest_first(self) -> list[int]:
        order, waiting = [], [self.f.root]
        while waiting:
            v = waiting.pop()
            order.append(v)
            waiting += self.f.kids[v]
        return order[::-1]

    def text(self, v: int, a: int, b: int) -> int:
        """Code points of the turns a..b (from 1) of the sequence of v."""
        s = self.start[self.f.row[v]]
        return self.sums[s + b] - self.sums[s + a - 1]

    def saved(self, v: int, d: int) -> int:
        """Savings of the node at depth d of v's chain and all below it."""
        return self.below[v] + (self.f.count[v] - 1) * self.text(v, d, self.f.depth[v])

    def shared(self, v: int) -> int:
        """How deep v's chain is shared with other blocks; the root always is."""
        return max(self.left if self.f.row[v] == 0 else 0, self.right if self.f.row[v] + self.f.count[v] == self.n else 0)

    def ends(self, v: int) -> list[int]:
        """Ids of the conversations that end in v, ascending."""
        a, d = self.f.row[v], self.f.depth[v]
        b = a
        while b < a + self.f.count[v] and self.lengths[b] == d:
            b += 1
        return self.ids[a:b]

    def chain(self, v: int) -> range:
        """The depths of v's chain: below its parent down to itself."""
        p = self.f.parent[v]
        return range(self.f.depth[p] + 1 if p >= 0 else self.f.depth[v], self.f.depth[v] + 1)

    def boundary(self) -> Iterator[dict]:
        """The shared nodes with what hangs complete below them."""
        f = self.f
        names: dict[tuple[int, int], bytes] = {}

        def name(v: int, d: int) -> tuple[int, bytes]:
            side = 0 if f.row[v] == 0 and d <= self.left else 1
            if (side, d) not in names:
                names[side, d] = hashlib.md5(self.keys[0 if side == 0 else -1][:KEY * d]).digest()
            return side, names[side, d]

        for v in self.deepest_first():
            deep = self.shared(v)
            for d in self.chain(v):
                if d > deep:
                    break
                if d < f.depth[v]:
                    under = [(v, d + 1)] if d + 1 > deep else []
                else:
                    under = [(c, d + 1) for c in f.kids[v] if d + 1 > self.shared(c)]
                side, own = name(v, d)
                yield {"node": own, "depth": d, "size": self.text(v, d, d) if d else 0, "n": f.count[v], "least": f.least[v],
                       "kids": len(under), "leaves": sum(self.leaves[c] for c, _ in under), "saved": sum(self.saved(c, x) for c, x in under),
                       "ends": np.array(self.ends(v) if d == f.depth[v] else [], np.int64).tobytes(),
                       "path": [name(v, x)[1] for x in range(d)], "side": side}

    def complete(self, told: list[dict]) -> Iterator[tuple]:
        """The rows of the block's own nodes; ``told`` has side, depth and the smallest id of shared ones."""
        f = self.f
        known = {(t["side"], t["depth"]): t["least"] for t in told}

        def least(v: int, d: int) -> int:
            if d > self.shared(v):
                return f.least[v]
            return known[0 if f.row[v] == 0 and d <= self.left else 1, d]

        for v in self.deepest_first():
            for d in self.chain(v):
                if d <= self.shared(v):
                    continue
                above = least(v, d - 1) if d > self.chain(v)[0] else least(f.parent[v], d - 1)
                end = d == f.depth[v]
                yield (f.least[v], d, above, f.count[v], len(f.kids[v]) if end else 1, self.leaves[v], self.saved(v, d),
                       hashlib.sha256(",".join(map(str, self.ends(v) if end else [])).encode()).hexdigest())


def _table(records: list, names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in records], t.type) for k, t in zip(names, schema)], schema=schema)


def _digests(shared: DataFrame) -> DataFrame:
    """node, ends_sha256: the ids that end in each shared node, streamed block by block."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, begun = None, hashlib.sha256(), False

        def done() -> pa.RecordBatch:
            return pa.record_batch({"node": pa.array([node], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})

        for r in rows(batches):
            if r["node"] != node:
                if node is not None:
                    yield done()
                node, state, begun = r["node"], hashlib.sha256(), False
            for k in np.frombuffer(r["ends"], np.int64).tolist():
                state.update((f",{k}" if begun else str(k)).encode())
                begun = True
        if node is not None:
            yield done()

    return shared.select("node", "block", "ends").repartition("node").sortWithinPartitions("node", "block") \
                 .mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(found: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The nodes of the trie of ``found`` (conv_id, distinct, and turns, as from ``sequences``): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    blocks = stage(_with_shared_depths(_blocks(found, block_bytes)), "trie-edges")
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "array<binary>": pa.list_(pa.binary())}
    shape = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _SHARED.split(", ")])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            held = [r | {"block": row["block"]} for r in _Block(row["held"], row["left"], row["right"]).boundary()]
            yield _table(held, shape.names, shape)

    shared = stage(blocks.mapInArrow(contract, _SHARED), "shared-nodes")
    merged = stage(shared.groupBy("node").agg(*(F.min(c).alias(c) for c in ("depth", "size", "least")), *(F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")),
                                            F.min("path").alias("path")), "merged-nodes")
    parent = F.when(F.col("depth") > 0, F.element_at("path", -1))
    inner = merged.select(parent.alias("node")).where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("inner"))
    whole = merged.join(inner, "node", "left").withColumn("n_children", F.col("kids") + F.coalesce("inner", F.lit(0)))
    given = whole.select(F.explode(F.concat("path", F.array("node"))).alias("node"),
                         (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
                         (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"))
    sums = given.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = merged.select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    joint = whole.select("node", parent.alias("parent"), F.col("least").alias("conv_id"), "depth", F.col("n").alias("n_convs"), "n_children") \
        .join(sums, "node").join(_digests(shared), "node").join(parents, "parent", "left")
    names = [x.split()[0] for x in _NODE.split(", ")]

    told = shared.select("block", "side", "depth", "node").join(merged.select("node", "least"), "node") \
        .groupBy("block").agg(F.collect_list(F.struct("side", "depth", "least")).alias("told"))
    out = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _NODE.split(", ")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            nodes = list(_Block(row["held"], row["left"], row["right"]).complete(row["told"]))
            for a in range(0, len(nodes), 20_000):
                yield _table(nodes[a:a + 20_000], range(len(out)), out)

    return joint.select(*names).union(blocks.join(told, "block").mapInArrow(write, _NODE))
