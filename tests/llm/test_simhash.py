import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm.simhash import Tree, bk_links, block_masks, fingerprint, linked, simhash_groups


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def grouped(ids, prints, radius=3):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return {i: find(i) for i in ids}


def flipped(rnd, value, most):
    for bit in rnd.sample(range(64), rnd.randrange(most + 1)):
        value ^= 1 << bit
    return value


def clouds(seed, n, families=12, most=3):
    """Distinct fingerprints: some far apart, some in chains and clouds."""
    rnd = random.Random(seed)
    found = {0}
    made = [0] + [rnd.getrandbits(64) for _ in range(families)]
    while len(found) < n:
        made.append(flipped(rnd, rnd.choice(made), most) if rnd.random() < 0.7 else rnd.getrandbits(64))
        found.add(made[-1])
    return sorted(found)


EDGES = [None, "", " \n\t", "one", "ONE", "two words", "two  Words\v", "a b c", "A b c", "a b c d", "x " * 5000, "À b c", "à b c", "word same line", "a b c"]


def test_groups_equal_brute_force(docs):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 5)))
    texts = list(EDGES)
    for _ in range(150):
        words = rnd.choice(texts[15:]).split(" ") if len(texts) > 30 and rnd.random() < 0.8 else [word() for _ in range(rnd.choice([2, 30, 200]))]
        for _ in range(rnd.randrange(0, 3)):
            words[rnd.randrange(len(words))] = word()
        texts.append(" ".join(words))
    prints = [brute_fingerprint(t) for t in texts]
    comps = grouped(list(range(len(texts))), prints)
    assert len(set(comps.values())) < len(texts) - 40
    found = sorted(tuple(r) for r in simhash_groups(docs(texts)).collect())
    assert found == [(k, format(p, "016x"), comps[k]) for k, p in enumerate(prints)]


def test_spark_hashes_shingles_alike(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("à b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("à b c".encode(), 42)
    assert fingerprint("à b c".encode()) == xxhash.xxh64_intdigest("à b c".encode(), 42)


@pytest.mark.parametrize(("tree", "part"), [(8, 4), (16, 50), (10_000, 60), (512, 8192)])
def test_shards_and_parts_lose_no_link(spark, tree, part):
    prints = clouds(2, 400)
    nodes = spark.createDataFrame([(1000 + k, p - (p >> 63 << 64)) for k, p in enumerate(prints)], "node long, fp long")
    links = [tuple(r) for r in bk_links(nodes, len(prints), tree=tree, part=part).collect()]
    joined = {1000 + k: 1000 + k for k in range(len(prints))}

    def find(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        joined[b] = a
    assert {k: find(k) for k in joined} == grouped([1000 + k for k in range(len(prints))], prints)


def test_trees_are_those_of_single_inserts():
    prints = np.array(clouds(3, 300), np.uint64)
    random.Random(4).shuffle(prints)
    made = Tree.of(prints, np.arange(300))
    children = {int(prints[0]): {}}
    for p in map(int, prints[1:]):
        at = int(prints[0])
        while (d := (p ^ at).bit_count()) in children[at]:
            at = children[at][d]
        children[at][d] = p
        children[p] = {}
    assert {int(p): {int(d): int(made.prints[c]) for d, c in enumerate(row) if c >= 0} for p, row in zip(made.prints, made.child, strict=True)} == children


def test_a_dense_cloud_gives_few_links():
    prints = np.array(sorted({(1 << a) | (1 << b) | (1 << c) for a in range(20) for b in range(20) for c in range(20)}), np.uint64)
    made = Tree.of(prints, np.arange(len(prints)))
    links = linked(made, made.prints, made.labels, 3, within=True)
    assert len(links) == len(prints) - 1 and set(made.labels.tolist()) == {0}


def test_block_masks_meet_for_every_pair_within_the_radius():
    rnd = random.Random(5)
    for nodes in (1, 10**8, 10**11):
        masks = block_masks(nodes)
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = flipped(rnd, a, 3)
            assert any(a & m == b & m for m in masks)
    assert [len(block_masks(n)) for n in (10**6, 10**8, 10**11)] == [4, 10, 20]


def test_null_ids_repeated_ids_and_empty_table(docs):
    assert simhash_groups(docs([])).count() == 0
    texts = ["a b c d e f", "g h i j k l", "a b c d e f", "a b c d e f", None, ""]
    found = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash_groups(docs(texts, [5, 5, 9, None, 7, 8])).collect())
    assert found == [(-1, -1), (5, 5), (5, 5), (7, 7), (8, 7), (9, 5)]
