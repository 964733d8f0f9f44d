"""Personal data: fixed kinds, and bootstrapped contextual extraction of identifiers that they miss.

Base spans are entities of four fixed kinds; they are the seeds. Every seed and every unknown identifier-like token stands in
lexical patterns (the words around it). Spark scores the graph of patterns and instances in rounds: a pattern's confidence for a
kind is the mean confidence of the distinct instances it stands with, an instance's is the noisy-or over its confident
patterns. Confidences only grow from round to round, and rounds go on until those of the confident patterns stand still (to
SETTLED in all). Then unknown tokens in confident patterns are reported as `seen_<kind>`.

A pattern is confident with LEAST_SEEDS distinct instances and a confidence of LEAST_PATTERN, an instance with LEAST_INSTANCE. An
unknown token is what stands between spaces, brackets, quotes, commas and semicolons and has a digit, an underscore or an @, of
any length; a plain word, or an identifier in groups parted by spaces, is never one. Patterns are made of the whole words that begin
or end within AROUND characters of an instance.

Defined results: a null or empty text has no spans; a null id is carried along; repeated rows give repeated results and count once
as evidence; ties between kinds go to the first by name; other columns of the input are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha256_of, stash, text_of, unstash

KINDS = ("email", "ip", "card", "phone")
LEAST_SEEDS = 3  # distinct instances behind a pattern
LEAST_PATTERN = 0.6
LEAST_INSTANCE = 0.7
SETTLED = 1e-6
BROADCAST_ROWS = 100_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match can't begin within a run of digits that failed from its start
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_PARTING = r"""\s"'<>(){}\[\],;|"""
_UNKNOWN = re.compile(rf"(?<![^{_PARTING}])[^{_PARTING}0-9_@]*[0-9_@][^{_PARTING}]*")
_WORD = re.compile(r"[^\W\d_]+|[=:#@]")
AROUND = 48
SPANS = "array<struct<start:long,ord:int,end:long,kind:string>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ once, with the local characters before it, in linear time also for texts without any other character."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, order of kind, end, kind), sorted: leftmost non-overlapping matches of each kind, without those that fail its test."""
    out = [(a, 0, b, "email") for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def around(text: str, start: int, end: int) -> tuple[int, int]:
    """Bounds of what stands within AROUND characters of a place, moved outward to whole words, however long these are."""
    first, last = max(0, start - AROUND), min(len(text), end + AROUND)
    while 0 < first < start and text[first].isalpha() and text[first - 1].isalpha():
        first -= 1
    while end < last < len(text) and text[last - 1].isalpha() and text[last].isalpha():
        last += 1
    return first, last


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: two words before, one before and one after."""
    first, last = around(text, start, end)
    before = _WORD.findall(text[first:start].lower())[-2:]
    after = _WORD.findall(text[end:last].lower())[:1]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def unknown_spans(text: str, taken: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens that no base span touches, without the marks that end a sentence."""
    spans, k = sorted((s[0], s[2]) for s in taken), 0
    reach = 0
    for m in _UNKNOWN.finditer(text):
        end = m.start() + len(m[0].rstrip(".:!?"))
        while k < len(spans) and spans[k][0] < end:
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= m.start() < end:
            yield m.start(), end


def occurrences(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, id, spans: base spans (kind set) and unknown ones (kind null), with value and patterns."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = base_spans(text)
                every = [(a, o, b, k) for a, o, b, k in base] + [(a, None, b, None) for a, b in unknown_spans(text, base)]
                rows.append([{"start": a, "ord": o, "end": b, "kind": k, "value": text[a:b], "patterns": patterns(text, a, b)} for a, o, b, k in every])
            yield pd.DataFrame({"rid": batch["rid"], "id": batch["id"].astype("Int64"), "spans": rows})

    schema = "rid long, id long, spans array<struct<start:long,ord:int,end:long,kind:string,value:string,patterns:array<string>>>"
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(find, schema)


def _few(rows: DataFrame) -> DataFrame:
    """rows for the side of a join that is broadcast if it is small, counted before."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows.hint("merge")


def _sure(doubts: Column) -> Column:
    """The noisy-or of confidences."""
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - doubts, F.lit(1e-6)))))


def bootstrap(found: DataFrame) -> DataFrame:
    """pattern, kind, confidence of the confident patterns. found: value, kind (null: unknown), pattern."""
    graph = stash(found.select("value", "kind", "pattern").distinct(), "graph")
    # a pattern of fewer instances can't be confident, and drops out with its edges
    sizes = stash(graph.groupBy("pattern").agg(F.count_distinct("value").alias("total")).where(F.col("total") >= LEAST_SEEDS), "sizes")
    edges = stash(graph.join(sizes, "pattern"), "edges")
    unstash(sizes)
    known = edges.where("kind is not null").select("value", "kind").distinct().withColumn("confidence", F.lit(1.0))
    unknown = edges.where("kind is null").select("pattern", "value").distinct()
    between = edges.select("pattern", "value", "total").distinct()
    believed, confident, before = known, None, -1.0
    while True:
        scored = between.join(believed, "value").groupBy("pattern", "kind", "total").agg(F.sum("confidence").alias("sum"), F.count(F.lit(1)).alias("n"))
        scored = scored.select("pattern", "kind", (F.col("sum") / F.col("total")).alias("confidence"), "n")
        patterns_now = stash(scored.where((F.col("n") >= LEAST_SEEDS) & (F.col("confidence") >= LEAST_PATTERN)).drop("n"), "patterns")
        seen = unknown.join(_few(patterns_now), "pattern").groupBy("value", "kind").agg(_sure(F.col("confidence")).alias("confidence"))
        instances_now = stash(seen.where(F.col("confidence") >= LEAST_INSTANCE), "instances")
        unstash(*([confident, instances] if confident is not None else []))  # noqa: F821
        confident, instances = patterns_now, instances_now
        believed = known.union(instances)
        now = confident.agg(F.coalesce(F.sum("confidence"), F.lit(0.0))).first()[0]
        if now - before <= SETTLED or not instances.limit(1).count():
            unstash(graph, edges, instances)
            return confident
        before = now


def personal_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, spans array<struct<start, ord, end, kind>>, base ones and discovered ones, sorted."""
    seen = stash(occurrences(documents, id_col, text_col), "occurrences")
    each = seen.where(F.size("spans") > 0).select("rid", F.explode("spans").alias("s")).select("rid", "s.*").withColumn("pattern", F.explode("patterns"))
    hits = each.where("kind is null").drop("kind").join(_few(bootstrap(each)), "pattern")
    places = hits.groupBy("rid", "start", "end", "kind").agg(_sure(F.col("confidence")).alias("c")).where(F.col("c") >= LEAST_INSTANCE)
    best = places.groupBy("rid", "start", "end").agg(F.min(F.struct((-F.round("c", 9)).alias("c"), "kind")).alias("b"))
    order = F.create_map(*[x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(len(KINDS) + n))])
    new = best.groupBy("rid").agg(F.collect_list(F.struct("start", order[F.col("b.kind")].alias("ord"), "end", F.concat(F.lit("seen_"), "b.kind").alias("kind"))).alias("new"))
    base = F.transform(F.filter("spans", lambda s: s["kind"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))
    joined = seen.select("rid", "id", base.alias("base")).join(new, "rid", "left")
    none = F.array().cast(SPANS)
    return joined.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", F.coalesce(F.col("new").cast(SPANS), none))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = personal_spans(documents, id_col, text_col)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["ord"] < len(KINDS))
    return found.select(F.col(id_col), *[of(k) for k in KINDS], sha256_of(_joined(base)).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
