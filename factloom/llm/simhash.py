"""Near-duplicates by SimHash, found in BK-trees.

A fingerprint has a bit for each in which over half of a text's shingle hashes (repeats included) have it set. Equal fingerprints
are one node. Two fingerprints that differ in at most RADIUS bits agree on J of any RADIUS + J blocks of bits, so each node goes to
one shard for each choice of J blocks, by a hash of the bits chosen: such a pair meets in at least one shard. A shard holds about
TREE nodes; J is the least with as many values of J blocks as that takes (billions of nodes take J = 2 or 3).

A BK-tree is made of the nodes of a shard, its children keyed by their Hamming distance to the parent; a search follows only the
edges within RADIUS of the query's own distance. A shard with many nodes (near copies that share a block) is dealt into parts of
about PART nodes: each part gets a tree once, and the trees are sent to the tasks that hold the shard's other parts, each pair of
parts once. No pairs are listed: a search joins components, leaves out subtrees whose nodes are all in the query's component by
now, and tells one link for each pair of components that it has joined. Links are exact, so nothing is left to confirm.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; rows with equal ids are documents of
their own with one component (that of the id); a row with a null id has a fingerprint, component_id null, and links nothing; other
columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stash, unstash
from .neardup import components
from .words import byte_column

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
TREE = 512
PART = 8192
_HASHES = 1 << 16
_PAIRS = 1 << 20  # of queries and nodes that a search holds at once
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# ---- fingerprints -----------------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Of a whole text in UTF-8."""
    words = text.translate(_LOWER).split()  # splits at 0x20 and 0x09 to 0x0D, as bytes do
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - np.array([len(w) + 1 for w in words])
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    firsts, lasts = starts[:n].tolist(), (ends[min(size, len(words)) - 1 :] - 1).tolist()
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, _HASHES):
        made = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(firsts[at : at + _HASHES], lasts[at : at + _HASHES], strict=True)], "<u8")
        set_bits += np.unpackbits(made.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint's bits as a long)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            whole = data.tobytes()
            made = [fingerprint(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], ["id", "fp"])

    return in_arrow(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), sign, "id long, fp long")


# ---- BK-trees ---------------------------------------------------------------------------------------------------------------


class Tree:
    """A BK-tree over distinct fingerprints; parents stand before their children.

    prints, parents (-1: the root), edges (the distance to the parent), labels (the smallest node of the component that a node is in).
    """

    def __init__(self, prints: np.ndarray, parents: np.ndarray, edges: np.ndarray, labels: np.ndarray):
        self.prints, self.parents, self.edges, self.labels = prints, parents, edges, labels
        self.child = np.full((len(prints), BITS + 1), -1, np.int32)
        below = np.flatnonzero(parents >= 0)
        self.child[parents[below], edges[below]] = below
        level, self.levels = np.flatnonzero(parents < 0), []
        while len(level):
            self.levels.append(level)
            held = self.child[level]
            level = held[held >= 0]

    @classmethod
    def of(cls, prints: np.ndarray, nodes: np.ndarray) -> Tree:
        """The tree that inserting the fingerprints one by one makes, built level by level. Each node is a component of its own."""
        places, parents, edges = [], [], []
        waiting, group = np.arange(len(prints)), np.zeros(len(prints), np.int64)
        group_parent, group_edge = np.array([-1]), np.array([0])
        made = 0
        while len(waiting):
            _, firsts, member = np.unique(group, return_index=True, return_inverse=True)
            places.append(waiting[firsts])
            parents.append(group_parent)
            edges.append(group_edge)
            rest = np.ones(len(waiting), bool)
            rest[firsts] = False
            own, waiting = member[rest], waiting[rest]
            distance = np.bitwise_count(prints[waiting] ^ prints[places[-1][own]]).astype(np.int64)
            keys, group = np.unique(own * (BITS + 1) + distance, return_inverse=True)
            group_parent, group_edge = made + keys // (BITS + 1), keys % (BITS + 1)
            made += len(firsts)
        order = np.concatenate(places)
        return cls(prints[order], np.concatenate(parents), np.concatenate(edges), nodes[order].copy())

    def mixed(self) -> np.ndarray:
        """Whether a node's subtree has nodes of more than one component."""
        out = np.zeros(len(self.labels), bool)
        for level in reversed(self.levels[1:]):
            up = self.parents[level]
            out[up[out[level] | (self.labels[level] != self.labels[up])]] = True
        return out


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, the smallest value that each is joined with) for the values that links a - b name."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return values, values[root]


def relabelled(labels: np.ndarray, values: np.ndarray, to: np.ndarray) -> np.ndarray:
    if not len(values):
        return labels
    at = np.minimum(np.searchsorted(values, labels), len(values) - 1)
    return np.where(values[at] == labels, to[at], labels)


def linked(tree: Tree, prints: np.ndarray, labels: np.ndarray, radius: int, within: bool = False) -> list[tuple[int, int]]:
    """Links (a, b) that join what a search of the tree finds; the tree's labels follow. within: the queries are the tree's own nodes.

    A link names components, not the nodes that touch, and is told only where it joins two.
    """
    links: list[tuple[int, int]] = []
    labels, step = labels.copy(), max(16, _PAIRS // max(1, len(tree.prints)))
    for at in range(0, len(prints), step):
        mixed = tree.mixed()
        own = (tree.labels if within else labels)[at : at + step].copy()
        asked = prints[at : at + step]
        query, place = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        met_a, met_b = [], []
        while len(query):
            distance = np.bitwise_count(asked[query] ^ tree.prints[place]).astype(np.int64)
            hit = np.flatnonzero(distance <= radius)
            if len(hit):
                a, b = own[query[hit]], tree.labels[place[hit]]
                new = a != b
                met_a.append(a[new])
                met_b.append(b[new])
                own[query[hit]] = b  # one of the components it touches; links hold the others together
            follow = [(query, tree.child[place, np.minimum(distance + d, BITS)], distance + d) for d in range(-radius, radius + 1)]
            query, place = (np.concatenate(x) for x in zip(*[(q[ok], c[ok]) for q, c, e in follow for ok in [(c >= 0) & (e >= 0) & (e <= BITS)]], strict=True))
            open_ = mixed[place] | (tree.labels[place] != own[query])
            query, place = query[open_], place[open_].astype(np.int64)
        if not met_a or not sum(map(len, met_a)):
            continue
        values, to = joined(np.concatenate(met_a), np.concatenate(met_b))
        changed = values != to
        links += zip(values[changed].tolist(), to[changed].tolist(), strict=True)
        tree.labels = relabelled(tree.labels, values, to)
        labels = relabelled(labels, values, to)
    return links


# ---- on Spark ---------------------------------------------------------------------------------------------------------------


def block_masks(nodes: int, radius: int = RADIUS, tree: int = TREE) -> list[int]:
    """A mask of bits for each choice of J of radius + J blocks, with J the least that tells enough values apart."""
    j = next((j for j in (1, 2) if nodes <= tree << (BITS * j // (radius + j))), 3)
    cuts = [BITS * k // (radius + j) for k in range(radius + j + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(chosen) for chosen in combinations(blocks, j)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


_TREES = "shard long, part int, parts int, prints array<long>, parents array<int>, edges array<int>, labels array<long>, a array<long>, b array<long>"


def bk_links(nodes: DataFrame, n: int, radius: int = RADIUS, tree: int = TREE, part: int = PART) -> DataFrame:
    """a, b: links between nodes, enough to join all that are within radius of each other. nodes: node, fp (distinct), n of them."""
    masks, shards = block_masks(n, radius, tree), max(1, n // tree)
    slot = lambda k, mask: F.lit(k * shards).cast("long") + F.pmod(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(mask)))), F.lit(shards).cast("long"))
    dealt = nodes.select("node", "fp", F.explode(F.array(*[slot(k, mask) for k, mask in enumerate(masks)])).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("shard", F.ceil(F.col("size") / part).cast("int").alias("parts"))
    placed = dealt.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("fp", "shard"), F.col("parts")).cast("int"))

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        made = Tree.of(group["fp"].to_numpy().view(np.uint64), group["node"].to_numpy())
        links = linked(made, made.prints, made.labels, radius, within=True)
        parts = int(group["parts"].iloc[0])
        kept = (made.prints.view(np.int64), made.parents, made.edges, made.labels) if parts > 1 else ([], [], [], [])
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "part": group["part"].iloc[:1], "parts": [parts], "prints": [kept[0]], "parents": [kept[1]], "edges": [kept[2]], "labels": [kept[3]], "a": [[a for a, _ in links]], "b": [[b for _, b in links]]})

    trees = stash(placed.groupBy("shard", "part").applyInPandas(plant, _TREES), "trees")
    links = trees.select(F.explode(F.arrays_zip("a", "b")).alias("l")).select("l.a", "l.b")

    many = trees.where("parts > 1").select("shard", "part", "parts", "prints", "parents", "edges", "labels")
    # part p asks the trees of the parts behind it, so a tree goes to the tasks of all parts before its own
    sent = many.where("part > 0").withColumn("asker", F.explode(F.sequence(F.lit(0), F.col("part") - 1)))
    asking = many.where("part < parts - 1").withColumn("tree", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1))).select("shard", F.col("part").alias("asker"), F.col("tree").alias("part"), "prints", "labels")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        links = []
        for row, asked in zip(left.itertuples(), right.itertuples()):  # noqa: B905  a part that got no node has no tree, so one side can be empty
            made = Tree(np.asarray(row.prints, np.int64).view(np.uint64), np.asarray(row.parents), np.asarray(row.edges), np.asarray(row.labels))
            links += linked(made, np.asarray(asked.prints, np.int64).view(np.uint64), np.asarray(asked.labels), radius)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    keys = ["shard", "asker", "part"]
    across = sent.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(search, "a long, b long")
    return links.union(across)


def simhash_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tree: int = TREE, part: int = PART) -> DataFrame:
    """One row per input row: <id_col>, fingerprint, component_id."""
    signed = stash(fingerprints(documents, id_col, text_col), "fingerprints")
    nodes = stash(signed.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    # an id that stands in several rows joins their fingerprints
    many = signed.where("id is not null").groupBy("id").agg(F.min("fp").alias("fp"), F.max("fp").alias("other")).where("fp <> other").select("id")
    same = signed.join(many, "id", "left_semi").join(nodes, "fp")
    of_ids = same.groupBy("id").agg(F.min("node").alias("low")).join(same.select("id", "node"), "id").where("low <> node").select(F.col("low").alias("a"), F.col("node").alias("b"))
    links = stash(bk_links(nodes, nodes.count(), radius, tree, part).union(of_ids), "links")
    comps = components(links)
    placed = signed.join(nodes, "fp", "left").join(comps, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "node"))
    out = placed.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
    unstash(links)
    return out
