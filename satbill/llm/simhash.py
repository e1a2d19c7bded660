"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees over shards, grouped to components.

Two fingerprints that differ in at most four of six blocks of bits agree in the other two. So every fingerprint goes to
the fifteen shards named by two of its blocks' values, and every link lies within a shard. The fingerprints of a shard form BK-trees of
bounded size; a shard with several trees sends each tree to all blocks of its queries. A search follows the edges whose
distance is within the radius of the query's distance. What leaves a shard is a star for each group its links
connect, not all pairs. Components come from alternating large and small stars over written tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satbill.llm.batches import small_batches
from satbill.sources.snapshot import snapshot

RADIUS = 4
BLOCKS = 6  # two blocks agree at RADIUS 4; seven (35 shards of three blocks) suit above a billion fingerprints
TREE = 512  # fingerprints in a tree, and queries that search it at once


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint; 0 without words."""
    own = (text or b"").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not own:
        return 0
    line, n = b" ".join(own), len(own)
    if n <= words:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(line[a:b], 42) for a, b in spans), np.uint64, n - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint as a signed long, of every whole text; a null text has no words."""

    def run(batches):
        for batch in batches:
            own = [fingerprint(t) for t in batch.column("text").to_pylist()]
            fps = pa.array(np.array(own, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), fps], [*keep, "fp"])

    small_batches(docs.sparkSession)
    kinds = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep]).add("fp", "long")
    chosen = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, kinds)


class BKTree:
    """A BK-tree in flat arrays: a node's children hang at their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (value ^ self.values[at]).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]

    def within(self, value: int, radius: int) -> list[int]:
        """The numbers of the nodes at most ``radius`` away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if edges:
                todo += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found


def _forest(nodes: list[int], queries: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the tree of ``nodes`` links, among themselves or with ``queries`` of another block, as stars."""
    tree, own = BKTree(), nodes if queries is None else nodes + queries
    parent = list(range(len(own)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i, j):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)

    for i, value in enumerate(nodes):
        if queries is None:
            for j in tree.within(value, radius):
                join(i, j)
        tree.add(value)
    for i, value in enumerate(queries or []):
        for j in tree.within(value, radius):
            join(len(nodes) + i, j)
    return [(value, own[root(i)]) for i, value in enumerate(own) if root(i) != i]


def _search(batches):
    """Links of each shard's pair of blocks; the rows of a pair are consecutive, role 0 (nodes) before role 1 (queries)."""
    key, nodes, queries, out = None, [], [], []

    def close():
        if len(nodes) + len(queries) > 1:
            out.extend(_forest(nodes, None if key[1] == key[2] else queries, RADIUS))

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "tree", "block", "role", "fp")]
        for shard, tree, block, role, fp in zip(*columns, strict=True):
            if (shard, tree, block) != key:
                close()
                key, nodes, queries = (shard, tree, block), [], []
            (queries if role else nodes).append(fp & 0xFFFFFFFFFFFFFFFF)
        if len(out) > 10_000:
            yield _links(out)
            out = []
    close()
    yield _links(out)


def _links(pairs):
    ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])


def links(classes: DataFrame) -> DataFrame:
    """Links (u, v) that connect all fingerprints at most ``RADIUS`` bits apart; ``classes`` has each fp once."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    masks = []
    for chosen in combinations(range(BLOCKS), BLOCKS - RADIUS):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    shards = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))) for i, mask in enumerate(masks)])
    placed = classes.select("fp", F.explode(shards).alias("shard"))
    sizes = snapshot(placed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "simhash-shards")
    dealt = placed.join(sizes, "shard").select(
        "shard", "fp", F.ceil(F.col("n") / TREE).cast("int").alias("parts")
    ).withColumn("part", F.pmod(F.xxhash64("fp", "shard"), F.col("parts")).cast("int"))
    as_node = dealt.select(
        "shard", F.col("part").alias("tree"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("block"), F.lit(0).alias("role"), "fp"
    )
    as_query = dealt.where("part > 0").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("tree"), F.col("part").alias("block"), F.lit(1).alias("role"), "fp"
    )
    blocks = as_node.unionByName(as_query).repartition("shard", "tree", "block")
    return blocks.sortWithinPartitions("shard", "tree", "block", "role", "fp").mapInArrow(_search, "u long, v long").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node but the roots has one edge, and that to a root."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    odd = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out = 1 AND in = 1)")
    return not odd.agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v), roots left out; a root is the smallest node reachable.

    Alternates large and small stars: every node hands its larger neighbours, then its smaller ones, to the smallest. Each
    star is an aggregate and a join of written tables, so a hub's rows can be split between tasks. The loop ends when the
    edges are stars; the rounds grow with the logarithm of the longest chain.
    """
    edges = snapshot(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = snapshot(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "edges-large")
        edges = snapshot(both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        lowest = snapshot(edges.groupBy("u").agg(F.min("v").alias("m")), "edges-small")
        moved = edges.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = snapshot(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the columns ``keep`` with doc_id among them, fp, component_id, and root, which names the group.

    A group's root is one of its fingerprints, so groups whose rows have no ids are groups too.
    """
    rows = snapshot(fingerprints(docs, keep), "simhash-rows")
    classes = snapshot(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    linked = components(links(classes.select("fp")))
    linked = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    linked = snapshot(linked.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "first"), "simhash-linked")
    smallest = snapshot(linked.groupBy("root").agg(F.min("first").alias("component")), "simhash-roots")
    member = linked.join(smallest, "root").select("fp", "component", "root")
    named = classes.join(member, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return rows.join(snapshot(named, "simhash-named"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fp, fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id that can be reached over links, null where no row reached has an id. Texts without
    words share fingerprint zero. Repeated rows are rows of one class; an empty table gives no rows; further columns of
    ``docs`` are left out.
    """
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")
