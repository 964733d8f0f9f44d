import hashlib
import random
import re

import numpy as np
import pytest

from factloom.llm.decontaminate import FMIndex, contamination_report, decontaminated, suffix_order, with_hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(doc, items):
    have, hit, met = words(doc), set(), set()
    for item_id, text in items:
        w = words(text)
        windows = [w[i : i + 13] for i in range(max(1, len(w) - 12))] if w else []
        for x in windows:
            for i in range(len(have) - len(x) + 1):
                if have[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    met.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
    return len(have), len(hit), len(met), digest, bool(hit) and 20 * len(hit) >= len(have)


def case(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "AND", "é", "x1", "Zq", "kk"])
    items = [(k, " ".join(word() for _ in range(rnd.choice([0, 2, 5, 13, 14, 40])))) for k in [*range(8), 3, 10, 11]] + [(12, None), (None, "kk kk, kk kk kk?")]
    docs = [None, "", "..."]
    for _ in range(60):
        parts = [" ".join(rnd.choice([word(), word(), "out", "side"]) for _ in range(rnd.randrange(0, 80)))]
        for _ in range(rnd.randrange(0, 3)):
            parts.append(rnd.choice(items)[1] or "")
            parts.append("-".join(word() for _ in range(rnd.randrange(0, 40))))
        docs.append(". ".join(parts))
    return docs + ["the " * 3000], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_report_equals_brute_force(docs, spark, seed):
    texts, items = case(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in contamination_report(docs(texts), bench).collect()}
    assert len(rows) == len(texts)
    for n, text in enumerate(texts):
        r = rows[n]
        named = [("null" if i is None else i, t) for i, t in items]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(text, named), n


def test_blocks_give_the_same_as_one_block(docs, spark):
    texts, items = case(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, with_hits(docs(texts), bench, block_chars=n).select("doc_id", "__n_words", "__hit_spans", "__hit_items").collect())) for n in (1 << 20, 200))
    assert one == many


def test_the_index_finds_all_places():
    rnd = np.random.default_rng(3)
    symbols = rnd.integers(0, 4, 500)
    ends = np.append(np.sort(rnd.choice(499, 20, replace=False)), 499)
    symbols[ends] = -1
    key = [tuple(symbols[i : next(e for e in ends if e >= i)]) for i in range(500)]
    order = suffix_order(symbols, ends)
    assert sorted(range(500), key=lambda i: (key[i] + (-1,), i)) == order.tolist() or [key[i] for i in order] == sorted(key)
    index = FMIndex(symbols, ends)
    table = np.array([[-1, -1, 0], [-1, 1, 2], [3, 3, 3], [0, 1, 9]])
    low, high = index.ranges(table, np.array([1, 2, 3, 3]))
    for row, a, b in zip(table, low, high, strict=True):
        phrase = row[row >= 0].tolist()
        want = [i for i in range(500) if symbols[i : i + len(phrase)].tolist() == phrase]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_filter_keeps_columns_and_clean_rows(docs, spark):
    item = " ".join(f"q{i}" for i in range(20))
    table = docs([item, "clean text", None, item + " w" * 5000])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminated(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert decontaminated(docs([]), bench).count() == 0
    assert decontaminated(table, bench.limit(0)).count() == 4


def test_words_that_are_built_to_collide_stay_apart(spark, docs):
    word = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    items = spark.createDataFrame([("i", word)], "item_id string, text string")
    rows = contamination_report(docs([word, other, f"x {other} {word}"]), items).collect()
    assert [(r.n_hit, r.n_items) for r in sorted(rows)] == [(1, 1), (0, 0), (1, 1)]
