import random
import re

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm.neardup import WORD_BYTES, components, marks, near_duplicates, shingle_sets, without_near_duplicates
from factloom.llm.words import byte_column, word_hashes, word_spans


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sets = [shingles(t) for t in texts]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return sorted((k, len(s), find(k), k == find(k)) for k, s in zip(ids, sets, strict=True))


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 6)))
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.7:
            words = rnd.choice(texts[-40:]).split(" ")
            for _ in range(rnd.randrange(0, 4)):
                words[rnd.randrange(len(words))] = word()
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(word() for _ in range(rnd.choice([1, 3, 5, 60, 100, 150]))))
    return texts


EDGES = [None, "", " \t\n", "one", "ONE", "two words", "two  words\n", "a b c d e", "A b c d e", "a b c d f", "x " * 4000, "x x x x x x", "ÀB c", "àb c"]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(docs, seed):
    texts = corpus(seed) + EDGES
    assert sorted(tuple(r) for r in near_duplicates(docs(texts)).collect()) == brute(texts)


def test_one_large_group_in_which_most_pairs_are_no_links(docs):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(w if k not in cut else f"n{n}x{k}" for k, w in enumerate(base)) for n in range(150) for cut in [set(rnd.sample(range(100), 2))]]
    assert sorted(tuple(r) for r in near_duplicates(docs(texts)).collect()) == brute(texts)


def test_null_ids_repeated_rows_and_empty_table(docs):
    assert near_duplicates(docs([])).count() == 0
    rows = near_duplicates(docs(["a b c d e f"] * 4, [5, 3, 3, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (3, 3, True), (3, 3, True), (5, 3, False)]


def test_sets_do_not_depend_on_the_neighbours():
    texts = corpus(9, 40) + EDGES
    hashes, bounds = shingle_sets(*byte_column(pa.array(texts)))
    for n, text in enumerate(texts):
        own, _ = shingle_sets(*byte_column(pa.array([text])))
        assert np.array_equal(own, hashes[bounds[n] : bounds[n + 1]]) and len(own) == len(shingles(text))


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(n, n + 1)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(n)} | {(n, n), (n + 1, n)}


@pytest.mark.parametrize("seed", [11, 12])
def test_copies_of_copies_around_one_base(docs, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    texts = [base]
    for n in range(140):
        words = list(base if rnd.random() < 0.6 else rnd.choice(texts))
        for k in range(rnd.randrange(0, 5)):
            at = rnd.randrange(len(words))
            words[at : at + rnd.choice([0, 1, 1, 2])] = rnd.choice([[], [f"n{n}x{k}"], [f"n{n}x{k}", rnd.choice(base)]])
        texts.append(words)
    texts = [" ".join(t) for t in texts]
    rnd.shuffle(texts)
    want = brute(texts)
    assert len({r[2] for r in want}) > 5
    assert sorted(tuple(r) for r in near_duplicates(docs(texts)).collect()) == want


def test_marks_hold_every_id_and_little_else(spark):
    from pyspark.sql import functions as F

    for n, most in ((5000, 1 << 28), (5000, 1 << 16), (1, 1 << 28)):
        bitmap = marks(spark.range(n), most)
        bits = 8 * len(bitmap)
        slots = np.array([r[0] for r in spark.range(2 * n).select(F.pmod(F.xxhash64("id"), F.lit(bits))).collect()])
        held = bitmap[slots >> 3] >> (7 - (slots & 7)) & 1
        assert held[:n].all() and held[n:].mean() < (0.1 if most > 1 << 16 else 0.2)


def test_one_document_of_each_group_stays(docs):
    texts = ["a b c d e f g"] * 3 + [None, None, "other words here", "other words here"]
    table = docs(texts, [4, 2, 3, 8, None, 9, 9])
    kept = without_near_duplicates(table)
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "8", "9", "None"]


def test_the_pipeline_stage_takes_pairs_from_four_fifths_on(spark, docs):
    import corpus_pipeline

    rnd = random.Random(21)
    texts, pairs = [], []
    for n in range(40):
        words = [f"p{n}w{k}" for k in range(rnd.randrange(50, 120))]
        other = list(words)
        for at in rnd.sample(range(5, len(words) - 5), 1 + n % 3):
            other[at] += "x"
        pairs.append((" ".join(words), " ".join(other)))
    alike = [100 * len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    assert sum(80 <= x < 85 for x in alike) > 5 and sum(x < 80 for x in alike) > 5
    for pair in pairs:
        texts += pair
    words = [f"e{k}" for k in range(49)]  # 45 shingles, 5 of them changed: 40 of 50 are shared, 0.80 exactly
    exact = " ".join(words), " ".join([*words[:20], "new", *words[21:]])
    a, b = map(shingles, exact)
    assert (len(a & b), len(a | b)) == (40, 50)
    texts += exact
    alike.append(80)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(texts), "").collect()}
    assert kept == {k for n, x in enumerate(alike) for k in ((2 * n,) if x >= 80 else (2 * n, 2 * n + 1))}


def thue_morse(letters, n=1024):
    """A word of two letters that, with its complement, has equal polynomial hashes modulo 2^64 for every odd base."""
    return "".join(letters[k.bit_count() % 2] for k in range(n))


def test_words_that_are_built_to_collide_stay_apart(docs):
    texts = [thue_morse("ab"), thue_morse("ba"), thue_morse("ab", 4096) + " x y z", thue_morse("ba", 4096) + " x y z", thue_morse("AB")]
    assert [tuple(r)[2] for r in sorted(near_duplicates(docs(texts)).collect())] == [0, 1, 2, 3, 0]


def test_hashes_of_words_of_any_length():
    rnd = random.Random(11)
    words = sorted({"".join(rnd.choice("ab") for _ in range(n)) for n in [1, 2, 3, 5, 63, 64, 64, 65, 127, 128, 129, 200, 5000, 3 << 19, 3 << 19] for _ in range(4)})
    data, offsets = byte_column(pa.array([" ".join(words)]))
    starts, ends, _ = word_spans(data, offsets, WORD_BYTES)
    hashes = word_hashes(data, starts, ends, 5)
    assert len(set(hashes.tolist())) == len(words)
    for k, word in enumerate(words):
        own, _ = byte_column(pa.array([word.upper()]))
        assert word_hashes(own, np.array([0]), np.array([len(word)]), 5)[0] == hashes[k]
    assert not set(hashes.tolist()) & set(word_hashes(data, starts, ends, 6).tolist())
