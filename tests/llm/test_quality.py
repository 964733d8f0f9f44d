import random
import zlib

import numpy as np
import pytest

from factloom.llm import quality as Q


def text(rnd, good):
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(8, 400))]
    return " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(4)
    marks = {i: int(rnd.random() < 0.7) for i in range(300)}
    rows = [(i, text(rnd, m), "xx", 1.5, "s") for i, m in marks.items()]
    rows += [(300, None, "xx", 1.5, "s"), (301, "", "xx", None, "s"), (302, "long words " * 30_000, None, 1.5, "s"), (None, "words of no id", "xx", 1.5, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, id string")
    labels = spark.createDataFrame([(i, m, 0) for i, m in marks.items()] + [(None, 1, 0), (301, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, marks


def test_held_out_accuracy_and_edge_rows(table):
    docs, labels, marks = table
    rows = {r.doc_id: r for r in Q.quality_report(docs, labels).collect()}
    assert len(rows) == 304 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i in marks if rows[i].held_out]
    assert sum(rows[i].predicted == marks[i] for i in held) >= 0.95 * len(held) > 30
    assert rows[300].score == rows[301].score


def test_rejected_rows_go_and_columns_stay(table):
    docs, labels, _ = table
    report = {r.doc_id for r in Q.quality_report(docs, labels).where("predicted = 1").collect()}
    kept = Q.quality_filtered(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == report


def test_without_labels_or_rows(table):
    docs, labels, _ = table
    for some, share in ((labels.limit(0), 1), (labels.where("quality = 0"), 0)):
        assert all(abs(r.score - share) < 1e-6 for r in Q.quality_report(docs, some).collect())
    assert Q.quality_report(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 960, 961, 5000])
def test_chunks_cover_everything_and_overlap(n):
    data = np.random.default_rng(n).integers(1, 256, n).astype(np.uint8)
    chunks = Q.chunked(data)
    back = np.concatenate([chunks[0], *[c[Q.CHUNK - Q.HOP :] for c in chunks[1:]]])
    assert np.array_equal(back[:n], data) and not back[n:].any() and len(back) - n <= Q.CHUNK


def test_a_score_does_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    docs = [Q.chunked(rng.integers(1, 256, n).astype(np.uint8)) for n in (10, 100_000, 0, 700)]
    net = Q.fit(docs, np.array([0, 1, 0, 1], np.float32), np.array([10, 100_000, 0, 700], np.float32), epochs=1)
    sizes = np.array([10, 100_000, 0, 700])
    together = net.logits(Q._Chunks(docs), np.cumsum([0, *[len(d) for d in docs[:-1]]]), sizes)
    assert np.allclose(together, [net.logits(d, np.array([0]), sizes[k : k + 1])[0] for k, d in enumerate(docs)], atol=1e-4)


def test_a_step_follows_the_slope():
    rng = np.random.default_rng(2)
    docs = [Q.chunked(rng.integers(97, 122 if i % 2 else 105, 800).astype(np.uint8)) for i in range(40)]
    marks, sizes = np.array([i % 2 for i in range(40)], np.float32), np.full(40, 800, np.float32)
    loss = lambda net: np.mean([-np.log(Q.sigmoid((2 * m - 1) * net.logits(d, np.array([0]), sizes[:1])[0])) for d, m in zip(docs, marks, strict=True)])
    losses = [loss(Q.fit(docs, marks, sizes, epochs=e)) for e in (0, 8, 80)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1
