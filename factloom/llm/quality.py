"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Learned filters slide over each chunk's byte
embeddings, each filter keeps its maximum over the chunk, and the maxima - averaged and maximised over the chunks, with the
number of bytes - are combined by a small hidden layer into one probability. Scoring runs where the rows are; only the fitted numbers travel with the task.

Fitting uses a bounded sample: at most TRAIN_ROWS labelled rows of each class, the first by a hash of their id, each with all
its chunks; the prior of all labelled rows is put back afterwards. Held-out rows (crc32(id) mod 5 = 0) are never used.

Defined results: a null or empty text counts as one chunk of padding and has a score; a null id is held out; repeated rows
give repeated results; without labels of both classes every score is the share of label 1 (1.0 without any label); other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, numbered
from .words import byte_column

CHUNK, HOP = 512, 447  # odd, so that filters, which move by 2, meet a text at both phases
WIDTH, STRIDE = 8, 2
EMBED, FILTERS, HIDDEN = 8, 32, 16
TRAIN_ROWS = 4000
EPOCHS, BATCH_DOCS, RATE = 10, 48, 0.004
REJECT_BELOW = 0.3
SCORE_CHUNKS, SLOPE_CHUNKS = 1024, 1024
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunked(data: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) bytes; the last chunk is filled up with zeros."""
    n = max(1, -(-(len(data) - (CHUNK - HOP)) // HOP))
    whole = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    whole[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::HOP]


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    hidden: np.ndarray  # (2 * FILTERS + 1, HIDDEN)
    hidden_bias: np.ndarray  # (HIDDEN,)
    out: np.ndarray  # (HIDDEN,)
    offset: np.ndarray  # (1,)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.offset]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, POSITIONS, WIDTH * EMBED): the embeddings under each place of a filter."""
        flat = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(flat, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS, POSITIONS), before the threshold."""
        seen = np.ascontiguousarray(self.windows(chunks)).reshape(-1, WIDTH * EMBED) @ self.filters
        return seen.reshape(len(chunks), POSITIONS, FILTERS)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(chunks).max(axis=1) + self.bias, 0)

    def combined(self, top: np.ndarray, first: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs of the hidden layer, its values, logits) a document, from the maxima of its chunks."""
        sizes = np.diff(np.append(first, len(top)))[:, None]
        size = np.log1p(n_bytes).astype(np.float32)[:, None] / 4
        seen = np.concatenate([np.add.reduceat(top, first) / sizes, np.maximum.reduceat(top, first), size], axis=1).astype(np.float32)
        inner = np.tanh(seen @ self.hidden + self.hidden_bias)
        return seen, inner, inner @ self.out + self.offset[0]

    def logits(self, chunks: np.ndarray, first: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """A number a document; first: where each document's chunks begin."""
        top = np.concatenate([self.pooled(chunks[k : k + 64]) for k in range(0, len(chunks), 64)])
        return self.combined(top, first, n_bytes)[2]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(documents: list[np.ndarray], labels: np.ndarray, n_bytes: np.ndarray, seed: int = 17, epochs: int = EPOCHS) -> Network:
    """documents: chunks of each; labels 0 or 1. Adam on the log loss."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(normal(256, EMBED, scale=0.5), normal(WIDTH * EMBED, FILTERS, scale=0.12), np.zeros(FILTERS, np.float32), normal(2 * FILTERS + 1, HIDDEN, scale=0.12), np.zeros(HIDDEN, np.float32), normal(HIDDEN, scale=0.3), np.zeros(1, np.float32))
    net.embed[0] = 0
    held = net.parameters()
    moments, squares, steps = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        order = rng.permutation(len(documents))
        for k in range(0, len(order), BATCH_DOCS):
            batch = order[k : k + BATCH_DOCS]
            chunks = np.concatenate([documents[i] for i in batch])
            sizes = np.array([len(documents[i]) for i in batch])
            first, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(batch)), sizes)
            seen = np.concatenate([_with_place(net, chunks[j : j + 64]) for j in range(0, len(chunks), 64)])
            place, top = seen["place"], np.maximum(seen["value"] + net.bias, 0)
            given, inner, logits = net.combined(top, first, n_bytes[batch])
            wrong = ((sigmoid(logits) - labels[batch]) / len(batch)).astype(np.float32)
            to_inner = wrong[:, None] * net.out * (1 - inner * inner)
            to_given = to_inner @ net.hidden.T
            # back: to the pooled values, to the windows that gave the maxima, to the embeddings under them
            best = top >= given[owner, FILTERS : 2 * FILTERS]
            back = to_given[owner, :FILTERS] / sizes[owner, None] + best * to_given[owner, FILTERS : 2 * FILTERS]
            back = (back * (top > 0)).astype(np.float32)
            to_filters, to_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
            for j in range(0, len(chunks), SLOPE_CHUNKS):
                own, back_j = chunks[j : j + SLOPE_CHUNKS], back[j : j + SLOPE_CHUNKS]
                at = place[j : j + SLOPE_CHUNKS, :, None] * STRIDE + np.arange(WIDTH)
                under = own[np.arange(len(own))[:, None, None], at]
                shown = net.embed[under].reshape(len(own), FILTERS, WIDTH * EMBED)
                to_filters += np.einsum("cf,cfw->wf", back_j, shown, optimize=True)
                to_shown = (back_j[:, :, None] * net.filters.T[None]).reshape(-1, WIDTH, EMBED)
                for e in range(EMBED):
                    to_embed[:, e] += np.bincount(under.ravel(), to_shown[:, :, e].ravel(), 256)
            to_embed[0] = 0
            slopes = [to_embed, to_filters, back.sum(axis=0), given.T @ to_inner, to_inner.sum(axis=0), wrong @ inner, wrong.sum(keepdims=True)]
            steps += 1
            for p, g, m, s in zip(held, slopes, moments, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-7)
    return net


def _with_place(net: Network, chunks: np.ndarray) -> np.ndarray:
    values = net.responses(chunks)
    place = values.argmax(axis=1)
    out = np.empty(place.shape, [("place", np.int64), ("value", np.float32)])
    out["place"], out["value"] = place, np.take_along_axis(values, place[:, None], axis=1)[:, 0]
    return out


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def training_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, float]:
    """(chunks of each document, labels, bytes, share of label 1 among all rows that may be used)."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out("id")).distinct()
    share = usable.agg(F.avg("label")).first()[0]
    chosen = None
    for label in (0, 1):
        one = usable.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
        chosen = one if chosen is None else chosen.union(one)

    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    read = texts.join(F.broadcast(chosen), "id")  # at most 2 x TRAIN_ROWS ids
    rows = sorted({(r["id"], r["label"], bytes(r["data"])) for r in read.collect()})
    return [chunked(np.frombuffer(data, np.uint8)) for _, _, data in rows], np.array([r[1] for r in rows], np.float32), np.array([len(r[2]) for r in rows], np.float32), 1.0 if share is None else float(share)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    chunks, marks, n_bytes, share = training_sample(documents, labels, id_col, text_col, label_col)
    if len(set(marks.tolist())) < 2:
        net = fit([np.zeros((1, CHUNK), np.uint8)], np.zeros(1, np.float32), np.zeros(1, np.float32), epochs=0)
        net.out[:] = 0
        net.offset[0] = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return net
    net = fit(chunks, marks, n_bytes)
    net.offset += np.float32(np.log(share / (1 - share)) - np.log(marks.mean() / (1 - marks.mean())))
    return net


def with_score(documents: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """documents with score: the probability of label 1. documents have no column of that name."""
    at = documents.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(at))
            logits, held, first, count, sizes = [], [], [], 0, np.diff(offsets)
            for row in range(batch.num_rows):
                chunks = chunked(data[offsets[row] : offsets[row + 1]])
                first.append(count)
                held.append(chunks)
                count += len(chunks)
                if count >= SCORE_CHUNKS or row + 1 == batch.num_rows:
                    logits.append(net.logits(_Chunks(held), np.array(first), sizes[row + 1 - len(held) : row + 1]))
                    held, first, count = [], [], 0
            scores = sigmoid(np.concatenate(logits).astype(np.float64)) if logits else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, score_col])

    schema = documents.withColumn(score_col, F.lit(0.0)).schema
    for field in schema:
        field.nullable = True
    return in_arrow(documents, score, schema)


class _Chunks:
    """Chunk lists of several documents, put together 64 at a time."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts
        self.ends = np.cumsum([len(p) for p in parts])

    def __len__(self) -> int:
        return int(self.ends[-1])

    def __getitem__(self, span: slice) -> np.ndarray:
        start, stop = span.start, min(span.stop, len(self))
        k, out = int(np.searchsorted(self.ends, start, "right")), []
        while start < stop:
            base = int(self.ends[k]) - len(self.parts[k])
            upto = min(stop, int(self.ends[k]))
            out.append(self.parts[k][start - base : upto - base])
            start, k = upto, k + 1
        return np.concatenate(out)


def quality_report(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    net = train(documents, labels, id_col, text_col, label_col)
    scored = with_score(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), net)
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))


def quality_filtered(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents that the classifier does not reject."""
    net = train(documents, labels, id_col, text_col)
    rows, (text,) = numbered(documents, text_col)
    return with_score(rows, net, text).where(F.col("score") >= REJECT_BELOW).drop("score").toDF(*documents.columns)
