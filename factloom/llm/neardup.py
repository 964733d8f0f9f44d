"""Near-duplicate groups by min-max hashing.

A document's set is its distinct word shingles. Under each permutation both the minimum and the maximum are kept, so a
signature of 2 x PERMUTATIONS values costs PERMUTATIONS hash evaluations; each band takes both ends of three permutations.
Equal sets are collapsed to one node first. In a bucket each node is compared with one pivot, the node that shares the most
buckets, not with every other node. What then still lies in different components is searched for missing links exactly and
without all pairs: within the nodes of a pivot P, two sets A and B that are similar enough, not both to P, share elements of
their differences to P (see missing_links()), so rare elements of the differences index the candidates. Every link is confirmed
on the full sets.

Defined results: null, empty and blank texts have an empty set (n_shingles 0) and stand alone; with fewer words than a
shingle has, the whole sequence is the one shingle; rows with equal ids count as one document; a row with a null id stands
alone, component_id null, kept; other columns of the input are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, numbered, stash, unstash
from .words import byte_column, mix, new_seed, slabs, word_hashes, word_spans

SHINGLE = 5
THRESHOLD = 85  # hundredths; op5's contract
STAGE_THRESHOLD = 80  # hundredths; where one document of each group stays
PERMUTATIONS = 120
BANDS = 40  # each of the minima and maxima of PERMUTATIONS / BANDS permutations: a pair at 0.85 misses all with 6e-9, at 0.80 with 5e-6
SMALL_GROUP = 8
MARK_BITS = 1 << 28
BROADCAST_IDS = 200_000
ROWS_A_SET = 2000

WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
_random = np.random.Generator(np.random.PCG64(7))
_PLACES = _random.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_FACTORS = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingle hashes of row r are hashes[bounds[r]:bounds[r + 1]]."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets, WORD_BYTES)
    words = word_hashes(data, starts, ends, seed)
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    if len(words) >= SHINGLE:
        long = len(words) - SHINGLE + 1
        made = np.zeros(long, np.uint64)
        for k in range(SHINGLE):
            made += words[k : k + long] * _PLACES[k]
        whole = rows[:long] == rows[SHINGLE - 1 :]
        hashes, owner = mix(made[whole]), rows[:long][whole]
    else:
        hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        own = np.array([int((words[first[r] : first[r] + count[r]] * _PLACES[: count[r]]).sum()) for r in short], np.uint64)
        hashes = np.concatenate([hashes, mix(own + count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row a set, a column a band. starts: where each (not empty) set begins in hashes."""
    keys = np.empty((len(starts), BANDS), np.uint64)
    each = PERMUTATIONS // BANDS
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for k in range(band * each, (band + 1) * each):
            moved = (hashes ^ _FLIPS[k]) * _FACTORS[k]
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(moved, starts))
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.maximum.reduceat(moved, starts))
        keys[:, band] = key
    return keys


def signatures(documents: DataFrame, id_col: str, text_col: str, seed: int = 0) -> DataFrame:
    """id, n, f1, f2 (a 128-bit print of the set), bands (null for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            for first, last in slabs(offsets):
                hashes, bounds = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], seed)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                prints = np.zeros((2, len(n)), np.uint64)
                bands = np.full(len(n), None, object)
                if len(some):
                    starts = bounds[some]
                    prints[0, some] = np.add.reduceat(hashes, starts)
                    prints[1, some] = np.add.reduceat(mix(hashes * np.uint64(0x2545F4914F6CDD1D)), starts)
                    for r, keys in zip(some, band_keys(hashes, starts).view(np.int64), strict=True):
                        bands[r] = keys
                columns = [batch.column(0).slice(first, last - first), pa.array(n.astype(np.int64)), *[pa.array(p.view(np.int64)) for p in prints], pa.array(bands.tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "f1", "f2", "bands"])

    return in_arrow(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), sign, "id long, n long, f1 long, f2 long, bands array<long>")


def marks(ids: DataFrame, most_bits: int = MARK_BITS) -> np.ndarray:
    """A bitmap of hashed ids, of a bounded size whatever the number of ids. ids: one column, id."""
    n = ids.count()
    bits = min(most_bits, 1 << max(16, (16 * n).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    made = ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    out = np.zeros(bits + 32768, bool)
    for row in made.collect():  # 4 KB for each 32768 bits
        first = (row["k"] - 1) * 32768 + 1  # bucket k holds 32768 (k - 1) + 1 and on; slot 0 falls in bucket 0
        own = np.unpackbits(np.frombuffer(row["m"], np.uint8), bitorder="little")
        out[max(0, first) : first + 32768] |= own[max(0, -first) :].astype(bool)
    return np.packbits(out[:bits])


def full_sets(documents: DataFrame, id_col: str, text_col: str, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """id, shingles (sorted distinct hashes) of the rows with a wanted id (and of a few others), where they are read: no text is shuffled.

    More wanted ids than a bitmap of MARK_BITS can tell apart are joined instead.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    if 4 * wanted.count() > MARK_BITS:
        rows = rows.join(wanted.hint("merge"), "id", "left_semi")
        marked = np.full(1, 255, np.uint8)
    else:
        marked = marks(wanted)
    bits = 8 * len(marked)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(marked[slot >> 3] >> (7 - (slot & 7)) & 1 == 1))
            data, offsets = byte_column(batch.column(1))
            for first, last in slabs(offsets):
                hashes, bounds = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], seed)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], ["id", "shingles"])

    return in_arrow(rows.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(bits))), build, "id long, shingles array<long>")


def with_sets(rows: DataFrame, sets: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """rows with the set of `key`, called `name`. Rows of a key with many are dealt by `other` to as many tasks as it takes, each with a copy of the set.

    Rows are ids alone, so that Spark, which goes by bytes, would not see which partition a set makes large.
    """
    parts = rows.groupBy(F.col(key).alias("id")).agg(F.floor(F.count(F.lit(1)) / ROWS_A_SET).alias("parts")).where("parts > 0")
    own = sets.join(parts, "id", "left").select(F.col("id").alias(key), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(0).cast("long")))).alias("part"), F.col("shingles").alias(name))
    dealt = rows.join(parts.withColumnRenamed("id", key), key, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(0).cast("long")) + 1)).drop("parts")
    return dealt.join(own, [key, "part"]).drop("part")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    held = with_sets(pairs, sets, "a", "b", "sa").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either"))
    return held.where(100 * F.col("both") >= threshold * F.col("either")).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of edges (a, b): hooking to smaller labels and pointer jumping."""
    n = 2 * edges.count()
    both = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges", n)
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels", n)
    while True:
        least = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        seen = labels.join(least, "node")
        told = seen.select("node", F.least("comp", "m").alias("m")).union(seen.select(F.col("comp").alias("node"), "m"))
        hooked = told.groupBy("node").agg(F.min("m").alias("h"))
        roots = hooked.select(F.col("node").alias("h"), F.col("h").alias("root"))
        moved = hooked.join(roots, "h").select("node", F.least("h", "root").alias("comp"))
        next_labels = stash(moved, "labels", n)
        changed = next_labels.join(labels.withColumnRenamed("comp", "old"), "node").where("comp <> old").limit(1).count()
        unstash(labels)
        labels = next_labels
        if not changed:
            unstash(both)
            return labels


def comparable(x: str, y: str, threshold: int = THRESHOLD) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return threshold * F.greatest(x, y) <= 100 * F.least(x, y)


def pivot_groups(banded: DataFrame) -> DataFrame:
    """pivot, pn, node, n: each node with the pivots of its buckets, itself not. banded: node, n, key, a row a band."""
    buckets = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("key", "size")
    members = stash(banded.join(buckets, "key"), "members")
    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    scored = members.join(score, "node")
    pivots = scored.groupBy("key").agg(F.max(F.struct("score", -F.col("node"), "node", "n")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"))
    groups = stash(members.join(pivots, "key").where("node <> pivot").select("pivot", "pn", "node", "n").distinct(), "groups")
    unstash(members)
    return groups


def missing_links(groups: DataFrame, links: DataFrame, comps: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Candidate pairs (a, b) of the same pivot's nodes, in different components, that may be links.

    With d(A) the symmetric difference of A and the pivot P, and D = |A symdiff B| = |d(A)| + |d(B)| - 2 |d(A) & d(B)|: A and B
    are similar enough only if D <= r (|A| + |B|) with r = (100 - t) / (100 + t). At least one of the pair, B, has no link to P, so
    |d(B)| > r (|B| + |P|); hence the differences share more than (|d(A)| + r (|P| - |A|)) / 2 elements, at least one. Also
    |d(A)| >= |d(B)| - D, so they share at least |d(B)| - D; and if |d(A)| <= |d(B)|, at least |d(A)| - D / 2. Two sets that share
    o elements share one among the first |d| - o + 1 in any common order: here from rare to frequent within the pivot's nodes.
    """
    rise, fall = 100 - threshold, 100 + threshold
    linked = links.select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.lit(True).alias("linked"))
    placed = groups.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tops = comps.select(F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp"))
    placed = placed.join(tops, "pivot", "left").withColumn("pivot_comp", F.coalesce("pivot_comp", "pivot"))
    state = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("size > 1 and low < high").select("pivot", "size")
    left = stash(placed.join(state, "pivot").join(linked, ["pivot", "node"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))).drop("pivot_comp"), "open")

    few = left.where(F.col("size") <= SMALL_GROUP)
    other = few.select("pivot", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    pairs = few.join(other, "pivot").where((F.col("node") < F.col("b")) & (F.col("comp") != F.col("cb")) & comparable("n", "nb", threshold)).select(F.col("node").alias("a"), "b")

    many = left.where(F.col("size") > SMALL_GROUP)
    own = sets.select(F.col("id").alias("node"), F.col("shingles").alias("s"))
    differ = F.concat(F.array_except("s", "p"), F.array_except("p", "s"))
    diffs = stash(with_sets(many, sets, "pivot", "node", "p").join(own, "node").select("pivot", "pn", "node", "n", "comp", "linked", differ.alias("d")), "differences")
    each = diffs.select("pivot", "node", F.explode("d").alias("e"))
    common = each.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")  # an element of one node is no candidate's
    ranked = each.join(common, ["pivot", "e"], "left").groupBy("pivot", "node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "e"))).alias("order"))
    sized = diffs.withColumn("x", F.size("d").cast("long")).drop("d").join(ranked, ["pivot", "node"])
    most = F.floor(F.lit(rise) * F.col("n") / F.lit(threshold))  # of D, whatever the other's size
    by_free = F.floor((fall * F.col("x") + rise * (F.col("pn") - F.col("n"))) / F.lit(2 * fall)) + 1
    by_size = F.col("x") - F.floor(most / 2)
    share = F.greatest(F.lit(1), F.when(F.col("linked"), by_free).otherwise(F.greatest(by_free, by_size)))
    first = lambda length: F.explode(F.filter(F.slice("order", 1, F.greatest(F.lit(0), length).cast("int")), lambda o: o["df"] > 1))
    index = sized.select("pivot", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("x").alias("xa"), "linked", first(F.col("x") - share + 1).alias("o")).withColumn("e", F.col("o.e"))
    probe = sized.where("not linked").select("pivot", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("x").alias("xb"), first(F.least(F.col("x"), most + 1)).alias("o")).withColumn("e", F.col("o.e"))
    ordered = F.col("linked") | (F.struct("xa", "a") < F.struct("xb", "b"))
    met = index.drop("o").join(probe.drop("o"), ["pivot", "e"]).where((F.col("ca") != F.col("cb")) & ordered & comparable("na", "nb", threshold))
    return pairs.union(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: <id_col>, n_shingles, component_id, kept."""
    seed = new_seed()
    signed = stash(signatures(documents, id_col, text_col, seed), "signatures")
    some = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    nodes = stash(some.groupBy("n", "f1", "f2").agg(F.min("id").alias("node")), "nodes")
    chosen = some.join(nodes, ["n", "f1", "f2"]).where("id = node")
    groups = pivot_groups(chosen.select("node", "n", F.explode("bands").alias("key")))

    together = groups.join(groups.groupBy("pivot").agg(F.count(F.lit(1)).alias("size")), "pivot").where((F.col("size") > 1) | comparable("n", "pn", threshold))
    wanted = together.select(F.col("node").alias("id")).union(together.select("pivot")).distinct()
    sets = stash(full_sets(documents, id_col, text_col, wanted, seed), "sets")

    stars = groups.where(comparable("n", "pn", threshold)).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    links = stash(confirmed(stars, sets, threshold), "links")
    comps = components(links)
    more = stash(confirmed(missing_links(groups, links, comps, sets, threshold), sets, threshold), "links")
    if more.limit(1).count():
        comps = components(links.union(more))
    unstash(sets, groups)

    placed = signed.drop("bands").join(nodes, ["n", "f1", "f2"], "left").join(comps, "node", "left")
    component = F.coalesce(F.when(F.col("id").isNotNull(), F.coalesce("comp", "node")), "id")
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = STAGE_THRESHOLD) -> DataFrame:
    """One document of each group: the one whose id is the group's; of rows with an equal id, one. Rows with a null id stay."""
    rows, (key, text) = numbered(documents, id_col, text_col)
    found = near_duplicates(rows, key, text, threshold).select(F.col(key).alias("id"), "kept")
    verdicts = stash(found.where("id is not null").groupBy("id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "verdicts")
    gone = verdicts.where("not kept").select("id")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = rows.join(F.broadcast(gone) if few else gone.hint("merge"), F.col(key) == F.col("id"), "left_anti")
    if verdicts.where("n > 1").limit(1).count():
        kept = kept.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(F.col(key).isNull()))
    return kept.toDF(*documents.columns)
