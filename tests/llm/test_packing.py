import functools
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm.packing import best_fit_plan, pack, pack_documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n ", "Plain words, and don't 12 more.", "x" * 9000, "a <|endoftext|> b<|startoftext|>c", "Á́b İ ẞ ΑΣ １２ a\x1cb q\x85z　w", "word " * 5000, "same", "same"]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def gapless(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pieces_are_the_tokenizer_s_ids(docs):
    rows = pack_documents(docs(TEXTS), PATH, capacity=64).collect()
    for n, text in enumerate(TEXTS):
        ids = ids_of(text)
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == n)
        assert own == [(k, 64 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(ids[i : i + 64] for i in range(0, len(ids), 64))]
    gapless(rows, 64)


@pytest.mark.parametrize("lengths", [[], [10] * 500, [1, 2, 3, 10, 9, 8, 7] * 40, [6] * 3 + [4] * 5 + [5] * 2])
def test_packing_is_best_fit(spark, lengths):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    rows = pack(df, 10).collect()
    assert Counter(r.length for r in rows) == Counter(lengths)
    rooms = []  # best-fit decreasing, one piece at a time
    for n in sorted(lengths, reverse=True):
        best = min((r for r in rooms if r >= n), default=None)
        if best is None:
            rooms.append(10 - n)
        else:
            rooms.remove(best)
            rooms.append(best - n)
    assert gapless(rows, 10) == len(rooms)


def test_plan_grows_with_lengths_not_pieces():
    few, many = ({n: 1 + k * (n % 7) for n in range(1, 301)} for k in (1, 10**6))
    assert len(best_fit_plan(many, 300)) < 4 * len(best_fit_plan(few, 300)) + 1000


def test_null_ids_and_empty_table(docs):
    assert pack_documents(docs([]), PATH).count() == 0
    assert sorted((r.doc_id is None, r.length) for r in pack_documents(docs(["a", "a"], [None, 4]), PATH).collect()) == [(False, 2), (True, 2)]


def test_every_latin_character_and_a_random_mix(docs):
    import random

    from factloom.llm.packing import WordTokenizer

    rnd = random.Random(8)
    own = WordTokenizer(PATH)
    texts = [chr(c) + f"a{chr(c)}{chr(c)}1 {chr(c).upper()}'s" for c in range(1, 0x260)]
    texts += ["".join(rnd.choice(["the", "ER", "'s", "'", "'ll", "é", "ß", "1", "²", "!", "-", " ", "\n", "\xa0", "\x85", "\x1c", "İ", "ŉ", "ǰ", "ﬁ", "<", "|", "Σ", "語"][: rnd.choice([18, 24])]) for _ in range(40)) for _ in range(400)]
    for text in texts:
        assert own(text) == np.array(ids_of(text)[:-1], "<u4").tobytes(), ascii(text)


def test_a_worker_keeps_a_bounded_share_of_memory_for_words():
    from factloom.llm.packing import WordTokenizer

    tokens, text = WordTokenizer(PATH), " ".join("".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(250_000))
    ids = tokens(text)
    kept = sum(len(w) + len(x) + 82 for w, x in tokens.known.items())  # 49 and 33 bytes more for each word and its ids
    assert kept < 16 << 20
    assert ids == np.array(ids_of(text)[:-1], "<u4").tobytes()
