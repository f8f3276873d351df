"""N-gram Jaccard join with rare-first prefix filtering.

A text's set holds its distinct word n-grams.  Two sets that are similar enough share an element among the first of each
in any common order; with rare elements first these prefixes meet seldom.

1. Chunks of documents make the sets; equal sets are one class and go on as one representative.
2. Chunks ask how many representatives hold each element (see exchange) and order every set by that, then by hash.
   Elements of one set only meet nothing; a set whose prefix has no others is done.
3. The other sets enter a list per prefix element with their size, the element's position and, for the suffix, how many
   elements behind it fall into each of CELLS cells of the hash range.  A pair from a list must pass

   * the length filter: the smaller set is large enough a part of the larger,
   * the positional filter: the elements up to the common one that other sets have too, and those left behind it, could
     make up the overlap,
   * the suffix filter: the same with the elements that could match cell by cell.

   Pairs that pass are made distinct and verified once, on the whole sets.
4. Not all pairs of a list are made.  A list first meets its set with the fewest rarer elements (near copies' common
   origin, if it is there); verified links are joined to components, and lists of several components meet further
   pivots while that joins more.  Then components meet by their roots: by the triangle inequality most pairs of components
   are too far apart for any link between their sets, and the sets of the others are paired.  So no link between
   components is lost, while a group of thousands of near copies costs a few pairs a set.

Lists and pivots that hold a large share of all rows are salted (see skew).  Elements and words are known by 64 bits.

Null and empty texts have empty sets, which link with nothing.  Each row gets a result row; rows of equal id are linked
like others.  A null id is a component's smallest only where there is no other.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm import chunks, exchange
from strideframe.llm.components import components
from strideframe.llm.exchange import expand, pack, squeeze, unpack
from strideframe.llm.sequences import gram_hash, mix, within, words
from strideframe.llm.skew import salted_join
from strideframe.llm.store import stage

SHINGLE, PERCENT = 4, 85
#: Cells of the hash range by whose counts suffixes are compared, eight bytes in one number.  A suffix with more than
#: MOST elements in a cell has all bytes set: its cells bound nothing.
CELLS, MOST = 16, 254
#: Bytes of documents behind a bucket's elements, on average.
BUCKET_BYTES = 32 << 20
# fixed values: words are runs of all but 0x20 and 0x09-0x0D
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)


class _Chunk:
    """The sets of a chunk's documents: ``hashes`` ascending within each document, which begin at ``first``."""

    def __init__(self, docs: bytes, shingle: int):
        self.doc_ids, data, offsets = chunks.load(docs)
        _, _, word, first = words(data, offsets, _WORD, _LOWER)
        size = np.diff(first)
        doc = np.repeat(np.arange(len(size)), size)
        whole = within(len(word), shingle, first) if len(word) >= shingle else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        hashes, owner = [mix(gram_hash(word, shingle))[at] if len(word) >= shingle else np.zeros(0, np.uint64)], [doc[at]]
        for n in range(1, shingle):  # a text of fewer words is one element
            few = np.flatnonzero(size == n)
            if len(few):
                hashes.append(mix(gram_hash(word, n)[first[few]] + np.uint64(n)))
                owner.append(few)
        h, d = np.concatenate(hashes), np.concatenate(owner)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        self.hashes, self.doc = h[new], d[new]
        self.first = np.searchsorted(self.doc, np.arange(len(size) + 1))

    def names(self) -> list[np.ndarray]:
        """128 bits for each set, whatever the order of its elements."""
        sums = (np.concatenate([[np.uint64(0)], np.cumsum(mix(self.hashes ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (0x5BD1E995, 0xC2B2AE3D27D4EB4F))
        return [(s[self.first[1:]] - s[self.first[:-1]]).view(np.int64) for s in sums]

    def keep(self, those: np.ndarray) -> None:
        """Leave out the elements of all documents but ``those``."""
        kept = np.zeros(len(self.first) - 1, bool)
        kept[those] = True
        inside = kept[self.doc]
        self.hashes, self.doc = self.hashes[inside], self.doc[inside]
        self.first = np.searchsorted(self.doc, np.arange(len(self.first)))

    def elements(self, buckets: int):
        """Distinct elements in the order of their hashes, sets that have each, where buckets begin, and each entry's element."""
        keys, index, count = np.unique(self.hashes, return_inverse=True, return_counts=True)
        width = np.uint64((1 << 64) // buckets + 1)
        starts = np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) * width)
        # 32 bits of the place within the bucket: elements that share them are only ordered as one
        short = ((keys % width) // np.uint64(max(1, int(width) >> 32) + 1)).astype(np.uint32) if len(keys) else np.zeros(0, np.uint32)
        return short, count, np.append(starts, len(keys)), index


def _messages(chunk: int, starts: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    sent = [k for k in range(len(starts) - 1) if starts[k + 1] > starts[k]]
    return pa.record_batch({
        "chunk": pa.array([chunk] * len(sent), pa.int64()), "bucket": pa.array(sent, pa.int32()),
        "payload": pa.array([pack(*(x[starts[k]:starts[k + 1]] for x in arrays)) for k in sent], pa.binary())})


def _frequencies(payloads: list[bytes]) -> list[bytes]:
    """For each element a class of its frequency: 0 for one set, else by eighths of its binary logarithm."""
    parts = [unpack(p, np.uint32, np.uint8) for p in payloads]
    _, index = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.bincount(index, weights=np.concatenate([n for _, n in parts]))
    classes = np.minimum(np.ceil(8 * np.log2(total)), 255).astype(np.uint8)[index]
    return [squeeze(c.tobytes()) for c in np.split(classes, np.cumsum([len(k) for k, _ in parts])[:-1])]


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _members(gathered: DataFrame, shingle: int) -> DataFrame:
    """chunk, i (the document's place there), doc_id, n, a, b (128 bits of its set)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            c = _Chunk(row["docs"], shingle)
            a, b = c.names()
            m = len(a)
            yield pa.record_batch({"chunk": pa.array(np.full(m, row["chunk"], np.int64)), "i": pa.array(np.arange(m, dtype=np.int32)), "doc_id": c.doc_ids,
                                   "n": pa.array(np.diff(c.first).astype(np.int64)), "a": pa.array(a), "b": pa.array(b)})

    return stage(gathered.mapInArrow(of, "chunk long, i int, doc_id long, n long, a long, b long"), "sets")


def _candidates(gathered: DataFrame, classes: DataFrame, shingle: int, percent: int, buckets: int) -> DataFrame:
    """sid, n, alone (elements of no other set), elements, entries (array of key, pos, low, high: the cells) of the representatives that
    may have a partner."""
    chosen = classes.groupBy("rep.chunk").agg(F.collect_list(F.struct("rep.i", "sid")).alias("reps"))
    asked = gathered.join(chosen, "chunk")

    def of(row) -> tuple[_Chunk, np.ndarray]:
        c = _Chunk(row["docs"], shingle)
        sids = np.full(len(c.first) - 1, -1, np.int64)
        sids[[r["i"] for r in row["reps"]]] = [r["sid"] for r in row["reps"]]
        c.keep(np.flatnonzero(sids >= 0))
        return c, sids

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            keys, count, starts, _ = of(row)[0].elements(buckets)
            yield _messages(row["chunk"], starts, keys, np.minimum(count, 255).astype(np.uint8))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            c, sids = of(row)
            keys, _, starts, index = c.elements(buckets)
            classes = np.zeros(len(keys), np.uint8)
            for r in row["replies"] or []:
                classes[starts[r["bucket"]]:starts[r["bucket"] + 1]] = np.frombuffer(expand(r["reply"]), np.uint8)
            rare = classes[index]
            n = np.diff(c.first)
            size = prefix_length(n, percent)
            alone = np.add.reduceat(np.append(rare == 0, False), c.first[:-1]) if len(n) else n
            found = []
            for i in np.flatnonzero((n > 0) & (alone < size)).tolist():
                a, b = c.first[i], c.first[i + 1]
                at = np.lexsort((c.hashes[a:b], rare[a:b]))
                own = c.hashes[a:b][at]
                p = np.arange(alone[i], size[i])
                cell = (own % np.uint64(CELLS)).astype(np.int64)
                tail = np.bincount(cell[size[i]:], minlength=CELLS)
                steps = np.zeros((size[i], CELLS), np.int64)
                steps[np.arange(size[i]), cell[:size[i]]] = 1
                behind = (tail + steps.sum(0) - np.cumsum(steps, axis=0))[p]
                behind[behind.max(1) > MOST] = 255
                low, high = np.ascontiguousarray(behind.astype(np.uint8)).view(np.int64).T.tolist() if len(p) else ([], [])
                found.append((int(sids[i]), int(n[i]), int(alone[i]), c.hashes[a:b].view(np.int64),
                              [dict(zip(("key", "pos", "low", "high"), e)) for e in zip(own[p].view(np.int64).tolist(), p.tolist(), low, high)]))
                if len(found) >= 200:
                    yield _rows(found)
                    found = []
            if found:
                yield _rows(found)

    told = stage(exchange.ask(asked.mapInArrow(send, exchange.MESSAGE), _frequencies), "frequencies")
    return stage(exchange.with_replies(asked, told).mapInArrow(
        order, "sid long, n int, alone int, elements array<long>, entries array<struct<key: long, pos: int, low: long, high: long>>"), "candidates")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    sid, n, alone, elements, entries = zip(*found)
    kind = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))
    return pa.record_batch({"sid": pa.array(sid, pa.int64()), "n": pa.array(n, pa.int32()), "alone": pa.array(alone, pa.int32()), "elements": pa.array(elements, pa.list_(pa.int64())),
                            "entries": pa.array(entries, kind)})


def _passes(percent: int) -> Column:
    """Whether two entries x and y of a list may belong to a pair that is similar enough."""
    x, y = ({k: F.col(f"{s}.{k}") for k in ("n", "pos", "alone")} | {"cells": [F.col(f"{s}.low"), F.col(f"{s}.high")]} for s in "xy")
    small, large = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
    needed = percent * (x["n"] + y["n"])  # (100 + percent) * overlap >= needed
    # elements ahead of the common one that other sets have as well, and those behind it
    ahead = F.least(x["pos"] - x["alone"], y["pos"] - y["alone"]) + 1
    rest = F.least(x["n"] - x["pos"], y["n"] - y["pos"]) - 1
    cell = [F.least(*(F.shiftrightunsigned(c["cells"][k // 8], 8 * (k % 8)).bitwiseAND(F.lit(255)) for c in (x, y))) for k in range(CELLS)]
    unbounded = (x["cells"][0] == -1) & (y["cells"][0] == -1)
    return (100 * small >= percent * large) & ((100 + percent) * (ahead + rest) >= needed) \
        & (unbounded | ((100 + percent) * (ahead + sum(cell[1:], cell[0])) >= needed))


def _compared(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v, more) with common and whole: the sizes of the intersection and union of their sets."""
    sets = candidates.select("sid", "elements")
    one = salted_join(pairs, sets.select(F.col("sid").alias("v"), F.col("elements").alias("of_v")), "v", "u")
    both = salted_join(stage(one, "half-pairs"), sets.select(F.col("sid").alias("u"), F.col("elements").alias("of_u")), "u", "v")
    common = F.size(F.array_intersect("of_u", "of_v"))
    return both.select(*pairs.columns, common.alias("common"), (F.size("of_u") + F.size("of_v") - common).alias("whole"))


def _paired(rows: DataFrame, percent: int) -> DataFrame:
    """u > v: distinct pairs of ``rows`` (x and y: an entry with its sid) that pass the filters."""
    return stage(rows.where((F.col("x.sid") != F.col("y.sid")) & _passes(percent))
                 .select(F.greatest("x.sid", "y.sid").alias("u"), F.least("x.sid", "y.sid").alias("v")).distinct(), "pairs")


def _links(candidates: DataFrame, percent: int) -> DataFrame | None:
    """u > v (sids): verified links that connect all that is similar enough, directly or by others."""
    x = F.struct("sid", "n", F.col("e.pos").alias("pos"), "alone", F.col("e.low").alias("low"), F.col("e.high").alias("high"))
    own = candidates.select("sid", "n", "alone", F.explode("entries").alias("e")).select(F.col("e.key").alias("key"), "sid", F.col("sid").alias("comp"), x.alias("x"))
    links = before = None
    while True:
        # of each component in a list its members and the one with the fewest rarer elements
        parts = own.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min(F.struct("x.pos", "sid", "x")).alias("best"))
        turn = F.lit(0).cast("long") if before is None else F.xxhash64("comp", F.lit(before))
        lists = stage(parts.groupBy("key").agg(
            F.sum("c").alias("size"), F.count("*").alias("comps"), F.min(F.struct(turn.alias("turn"), "best", "comp")).alias("pivot")).where("comps > 1"), "lists")
        left, size = lists.agg(F.sum(F.col("comps") * (F.col("comps") - 1) / 2), F.sum("size")).first()
        if not left:
            return links
        told = lists.select("key", F.col("pivot.comp").alias("of"), F.col("pivot.best.x").alias("y"))
        # lists whose sets are all connected are done with
        members = stage(salted_join(own, told, "key", "sid", counts=lists.select("key", F.col("size").alias("n"))), "members")
        if before is not None and (left <= size or left > 0.7 * before):
            return _bridged(members.drop("of", "y"), candidates, links, percent)
        found = stage(_compared(_paired(members.where("comp != of"), percent), candidates).where(100 * F.col("common") >= percent * F.col("whole"))
                      .select("u", "v"), "links")
        links = found if links is None else links.union(found)
        label = components(links).withColumnRenamed("u", "sid")
        before, own = left, members.join(label, "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("comp"), "x")


def _bridged(members: DataFrame, candidates: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links`` with all links between sets of different components that have a list in common.

    One minus the similarity is a distance.  A component's radius is the largest distance of its sets to its root; two
    components whose roots lie further apart than both radii and a link's length have no link.  Of the others' sets
    those are paired whose own distances to the roots leave room for a link.
    """
    apart = 1 - F.col("common") / F.col("whole")
    rays = members.where("sid != comp").select(F.col("sid").alias("u"), F.col("comp").alias("v")).distinct()
    rays = stage(_compared(stage(rays, "rays"), candidates).select(F.col("u").alias("sid"), F.col("v").alias("comp"), apart.alias("ray")), "rays")
    radius = stage(rays.groupBy("comp").agg(F.max("ray").alias("radius")), "radius")
    # a component with one set in a list meets others of one set by these two, else by their roots
    parts = stage(members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min("x").alias("x")), "parts")
    met = salted_join(parts, parts.select("key", F.col("comp").alias("v"), F.col("c").alias("d"), F.col("x").alias("y")), "key", "comp")
    lone = (F.col("c") == 1) & (F.col("d") == 1)
    met = stage(met.where((F.col("comp") > F.col("v")) & (~lone | _passes(percent))).select(lone.alias("lone"), F.col("comp").alias("u"), "v", "x", "y"), "met")
    roots = met.where("NOT lone").select("u", "v").distinct()
    measured = stage(_compared(stage(roots, "roots"), candidates), "root-distances")
    for side in "uv":
        measured = salted_join(measured, radius.select(F.col("comp").alias(side), F.col("radius").alias(f"radius_{side}")), side, "v" if side == "u" else "u", "left")
    near = measured.where(apart <= F.coalesce("radius_u", F.lit(0.0)) + F.coalesce("radius_v", F.lit(0.0)) + (100 - percent) / 100 + 1e-9)
    near = stage(near.select("u", "v", apart.alias("apart"), (100 * F.col("common") >= percent * F.col("whole")).alias("linked")), "near-components")
    # two components that are linked already need no further link
    open_ = near.where("NOT linked").select("u", "v", "apart")
    held = members.join(rays.select("sid", "ray"), "sid", "left").select("key", "sid", "comp", "x", F.coalesce("ray", F.lit(0.0)).alias("ray"))
    asking = salted_join(held.select("key", F.col("comp").alias("u"), F.col("x").alias("y"), F.col("ray").alias("ray_y")), open_, "u", "key") \
        .select(F.struct("key", F.col("v").alias("comp")).alias("at"), "y", "ray_y", "apart")
    asked = held.select(F.struct("key", "comp").alias("at"), "x", "sid", "ray")
    # the same inequality for the two sets themselves
    rows = salted_join(asked, asking, "at", "sid").where(F.col("apart") <= F.col("ray") + F.col("ray_y") + (100 - percent) / 100 + 1e-9)
    rows = rows.select("x", "y").union(met.where("lone").select("x", "y"))
    more = _compared(_paired(rows, percent), candidates).where(100 * F.col("common") >= percent * F.col("whole")).select("u", "v")
    return links.union(near.where("linked").select("u", "v")).union(stage(more, "links"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
            chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """doc_id, n (distinct shingles), set_a and set_b (the set's name: equal sets are one class) and component_id of each
    row; sets link when they have ``percent`` per cent of their union in common."""
    gathered = chunks.gather(docs, id_col, text_col, chunk_bytes)
    size = gathered.count() * chunk_bytes
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    members = _members(gathered, shingle)
    classes = stage(members.where("n > 0").groupBy("a", "b").agg(F.min(F.struct("chunk", "i")).alias("rep"), F.min("doc_id").alias("least"))
                    .withColumn("sid", F.monotonically_increasing_id()), "set-classes")
    links = _links(_candidates(gathered, classes, shingle, percent, buckets), percent)
    if links is None:
        rooted = classes.select("a", "b", "sid", "least", F.col("sid").alias("root"))
    else:
        rooted = classes.join(components(links).withColumnRenamed("u", "sid"), "sid", "left").select("a", "b", "sid", "least", F.coalesce("root", "sid").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("a", "b", "component_id")
    # classes hold a third of all rows at times: by id, not by set, no task gets them all
    out = salted_join(members.where("n > 0").select("a", "b", "doc_id", "n", F.xxhash64("a", "b").alias("ab"), F.xxhash64("chunk", "i").alias("at")),
                      named.select(F.xxhash64("a", "b").alias("ab"), F.col("a").alias("_a"), F.col("b").alias("_b"), "component_id"), "ab", "at") \
        .where("a = _a AND b = _b").select("doc_id", "n", F.col("a").alias("set_a"), F.col("b").alias("set_b"), "component_id")
    return out.union(members.where("n = 0").select("doc_id", "n", F.col("a").alias("set_a"), F.col("b").alias("set_b"), F.col("doc_id").alias("component_id")))
