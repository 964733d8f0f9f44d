import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import substrings as S


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    words = [[w.lower() if w.isascii() else w for w in WORD.findall(t or "")] for t in texts]
    passages = [{tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in words]
    shared = Counter(p for own in passages for p in own)
    out = []
    for d, own in zip(data, passages, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest(), any(shared[p] > 1 for p in own)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    noise = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passages = [noise(n) for n in (399, 400, 401, 500, 900, 1500)]
    texts = [None, "", "short", "x" * 399, "y" * 400, "z" * 401, "ab" * 900, passages[3] + passages[3], "Q" * 50 + passages[4].upper()]
    for _ in range(40):
        texts.append("".join(rnd.choice([noise(rnd.randrange(0, 700)), rnd.choice(passages), rnd.choice(passages)[rnd.randrange(300) :]]) for _ in range(rnd.randrange(1, 5))))
    words = lambda n: [rnd.choice("ab bc cd éf") for _ in range(n)]
    short, lone = words(90), words(60)
    for n in (49, 50, 51, 52, 70):
        texts.append(" ".join(words(rnd.randrange(80)) + short[rnd.randrange(90 - n) :][:n] + words(rnd.randrange(80))))
    texts += [" ".join(lone + words(3) + lone), "  ".join(short), " \n".join(["x"] * 50), " ".join(["y"] * 51), " ".join(["y"] * 51), " ".join(["y"] * 50), " ".join(["y"] * 50)]
    return texts + [texts[12]] * 3


@pytest.mark.parametrize(("seed", "slab"), [(1, 1 << 20), (2, 5000), (3, 1200)])
def test_removed_bytes_equal_brute_force(docs, seed, slab):
    texts = corpus(seed)
    kinds = S.BYTES._replace(slab=slab), S.WORDS._replace(slab=slab // 8)
    rows = {r.doc_id: tuple(r)[1:] for r in S.repeats_report(docs(texts).repartition(3), kinds=kinds).collect()}
    assert [rows[n] for n in range(len(texts))] == brute(texts)


def test_the_covers_meet_every_distance():
    for q, cover in ((13, S.BYTES.sparse), (3, S.BYTES.dense), (5, S.WORDS.sparse)):
        at = np.flatnonzero(cover.holds)
        assert len(at) == q + 1 and {(a - b) % cover.period for a in at for b in at} == set(range(cover.period))


def test_ties_of_suffixes_equal_brute_force():
    rnd = np.random.default_rng(3)
    for length, letters in ((20, 1), (20, 2), (15, 3)):
        joined = rnd.integers(97, 97 + letters, 300).astype(np.uint8)
        joined[150:220] = joined[20:90]
        begins, around = np.where(np.arange(300) < 100, 0, 100), 4
        ends = np.where(np.arange(300) < 100, 100, 300)
        places = np.concatenate([np.arange(0, 101 - length), np.arange(100, 301 - length)])
        made = S.suffixes(joined, places, begins[places], ends[places], length, around, True, S.BYTES.values)
        order = made.by_rank()
        found = S.shift_ties(made.take(order), around)
        for d in range(around + 1):
            full = {p: joined[p - d : p - d + length + around].tobytes() for p in places.tolist() if p - d >= begins[p] and p - d + length + around <= ends[p]}
            times = Counter(full.values())
            assert {p for p, t in zip(places[order].tolist(), found.tolist(), strict=True) if t >> d & 1} == {p for p, s in full.items() if times[s] > 1}
        kept = S.distinct(made.take(order), around)
        full = [(made.print[k], made.near[k].tobytes(), made.least[k], made.most[k]) for k in order]
        assert len(set(full)) == len(kept) == len({full[k] for k in kept})


def test_pieces_hold_every_window_once_or_more():
    for sizes in ([0, 10, 3000, 399, 400], [5000], [1201, 1200, 1199]):
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        for whole in (False, True):
            parts = [p for pieces in S.slab_pieces(offsets, 400, 1200, whole) for p in pieces]
            assert {(r, i) for r, b, e in parts for i in range(b, e - 399)} == {(r, i) for r, n in enumerate(sizes) for i in range(n - 399)}
            assert not whole or parts == [(r, 0, n) for r, n in enumerate(sizes)]


def test_repeated_rows_null_ids_and_empty_table(docs):
    assert S.repeats_report(docs([])).count() == 0
    text = "".join(random.Random(1).choice("abcdef") for _ in range(450))
    rows = S.repeats_report(docs([text, text, "one " * 3], [None, 1, 1])).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in rows) == [(-1, 450, 450), (1, 12, 0), (1, 450, 450)]
    assert sorted((r.doc_id, r.n_removed) for r in S.repeats_report(docs([text, text], [1, 1])).collect()) == [(1, 450), (1, 450)]


def test_copies_stand_in_for_each_other(docs):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    whole, short = word(900), word(399)
    texts = [whole, whole, whole, word(30) + whole[100:620] + word(40), short, short, whole[:450], word(500), word(100) + short]
    rows = {r.doc_id: tuple(r)[1:] for r in S.repeats_report(docs(texts).repartition(4)).collect()}
    assert [rows[n] for n in range(len(texts))] == brute(texts)


def test_planes_and_steps_keep_numbers():
    values = np.random.default_rng(1).integers(0, 2**64 - 1, 1000, dtype=np.uint64)
    assert (S.from_planes(S.planes(values), np.uint64) == values).all()
    places = np.sort(np.random.default_rng(2).choice(1 << 21, 500, replace=False)).astype(np.int32)
    assert (S.from_steps(S.steps(places)) == places).all() and not len(S.from_steps(S.steps(places[:0])))
