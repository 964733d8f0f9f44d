"""Best-fit packing planned over a histogram of lengths.

Texts become pieces of at most ``capacity`` tokens. Best-fit decreasing runs over the *counts* of piece lengths - at most
``capacity`` numbers, whatever the size of the corpus - and gives a plan of slots; pieces then take slots by joining on their
rank within their length. Ranks are taken within (length, salt) and shifted by the counts before, so that one common length is
no single group.

Defined results: a null or empty text is the closing id alone; a null id is carried along; repeated rows are packed each on
its own; other columns of the input are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEPT, freed, stash, text_of

CAPACITY = 2048
END_ID = 0
#: Words that a worker keeps with their ids; an executor has several workers, which outlive their tasks. At sf0.1 all 280,000 words took 40 MB, these take 10 MB in about the same time.
CACHE_WORDS = 100_000
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def _latin_rule(rule: str) -> str:
    """The vocabulary's cutting rule for texts up to U+017F, with its classes spelled out as `re` has none."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x180)]
    of = lambda kind: "".join(re.escape(chr(c)) for c, k in enumerate(kinds) if k == kind)
    return rule.replace("[\\p{L}]", f"[{of('L')}]").replace("[\\p{N}]", f"[{of('N')}]").replace("\\p{L}\\p{N}", of("L") + of("N"))


class WordTokenizer:
    """ids of texts as little-endian unsigned 32-bit integers.

    A text up to U+017F is lower-cased and cut by the vocabulary's own rule, and each word is encoded once and kept: up to there
    NFC changes nothing and lower case goes character by character. Any other text is left to the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = re.compile(_latin_rule(json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])).findall
        self.latin = re.compile("[\t-\r -;=-~\u00a0-\u017f]*").fullmatch  # without "<", which may begin a special token
        self.model = self.tokenizer.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}

    def learn(self, word: str) -> bytes:
        seen = word if word.isascii() else self.as_bytes.pre_tokenize_str(word)[0][0]
        data = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(seen)])
        if len(self.known) < CACHE_WORDS:
            self.known[word] = data
        return data

    def __call__(self, text: str) -> bytes:
        if not self.latin(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.cut(text.lower())
        found = list(map(self.known.get, words))
        if None in found:
            found = [self.learn(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return b"".join(found)


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker and path, with the words that it has learnt, until a task of another operator drops it."""
    if path not in KEPT:
        KEPT[path] = WordTokenizer(path)
    return KEPT[path]


def tokenized_pieces(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = word_tokenizer(tokenizer_path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                ids = tokens(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            made = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
            made["id"] = made["id"].astype("Int64")
            yield made

    return documents.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInPandas(freed(cut, keeps=True), PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Rows (length, first_rank, bins, each, first_sequence, first_offset): the pieces of that length with ranks from first_rank
    go, `each` to a sequence, to the `bins` sequences from first_sequence, at first_offset and on. A run of equal open
    sequences is one entry, so work and plan grow with the number of lengths, not of pieces.
    """
    plan, sequences = [], 0
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
    rooms: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_runs:
                open_runs[room] = []
                insort(rooms, room)
            open_runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[at]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                plan.append((length, rank, 1, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(room, first + full, n - full)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (any columns, with `length` from 1 to capacity) with sequence_id and offset.

    The histogram that comes to the driver has at most `capacity` rows, the plan is bounded by the square of that.
    """
    spark = pieces.sparkSession
    numbered = stash(pieces.withColumn("__slot", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(64, sum(counts.values()) // 20_000)
    salted = numbered.withColumn("__salt", F.pmod(F.xxhash64("__slot"), F.lit(salts)))
    sizes = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("__before", F.sum("n").over(W.partitionBy("length").orderBy("__salt")) - F.col("n")).drop("n")
    within = F.row_number().over(W.partitionBy("length", "__salt").orderBy("__slot"))
    ranked = salted.withColumn("__rank", within).join(before, ["length", "__salt"]).withColumn("__rank", F.col("__rank") - 1 + F.col("__before"))

    plan = spark.createDataFrame(best_fit_plan(counts, capacity), "length long, first_rank long, bins long, each long, first_sequence long, first_offset long")
    step = 10_000  # a run of slots is opened up in two steps, so that no task makes all slots of a common length
    parts = plan.withColumn("b0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1, F.lit(step).cast("long")))).repartition(spark.sparkContext.defaultParallelism)
    bins = parts.withColumn("b", F.explode(F.sequence("b0", F.least(F.col("b0") + step, F.col("bins")) - 1)))
    each = bins.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("each") - 1)))
    slots = each.select("length", (F.col("first_rank") + F.col("b") * F.col("each") + F.col("j")).alias("__rank"), (F.col("first_sequence") + F.col("b")).alias("sequence_id"), (F.col("first_offset") + F.col("j") * F.col("length")).alias("offset"))
    # slots are as many as pieces, which the small plan they come from hides from the optimizer
    return ranked.join(slots.hint("merge"), ["length", "__rank"]).drop("__slot", "__salt", "__rank", "__before")


def pack_documents(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    packed = pack(tokenized_pieces(documents, tokenizer_path, id_col, text_col, capacity), capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
