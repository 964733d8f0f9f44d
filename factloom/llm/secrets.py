"""Secret scans by multipart credential linking, in DataFrame functions only.

Parts of credentials are found as spans of whole texts. Strong secrets (the *base* kinds) are reported as they are. Weak
parts - any long mixed token, an account name, an endpoint - are reported only where the complementary parts stand within
``reach`` code points in the same document. The interval join behind that pre-aggregates each side by (row, class, bin of
``reach`` code points), so that a weak part meets at most three rows of a class and no pairs within a group are made.

Defined results: a null or empty text has no spans; a null id is carried along; repeated rows give repeated results; other
columns of the input, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, sha256_of, stash, text_of, unstash

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ with at least 20 characters: a run that is too short holds no longer one
HEX = r"[0-9a-f]{24,}"  # likewise

#: kind -> (pattern, class of the part, strong). Order is the order of kinds at equal starts.
KINDS = {
    "assign": (ASSIGN, "secret", True),
    "access": (ACCESS, "ident", True),
    "hex": (HEX, "secret", True),
    "weak_ident": (r"""(?i:client_?id|user_?name|account|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", "ident", False),
    "weak_secret": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}", "secret", False),
    "endpoint": (r"""(?i:https?|jdbc:[a-z0-9]{2,16}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+""", "endpoint", False),
}
#: What has to co-occur with a weak part of a class.
COMPLEMENT = {"secret": ["ident"], "ident": ["secret"], "endpoint": ["ident", "secret"]}
BASE = ("assign", "access", "hex")
REACH = 400
BROADCAST_ROWS = 50_000
BLOCK = 1024


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind, gap, len, ok>>: leftmost non-overlapping matches; gap is the distance from the previous one's end."""
    pattern = KINDS[kind][0]
    # a text is split around its matches, so lengths of pieces and matches give all places in one pass
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        ok = lambda i: F.length(F.get(values, i)) >= 6
    else:
        ok = lambda i: F.lit(True)
    made = F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"), ok(i).alias("ok")))
    return F.when(text.rlike(pattern), made)


def find_parts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "secret-parts") -> tuple[DataFrame, DataFrame]:
    """(rows, parts). rows: rid, id, print (a hash of the text). parts: rid, kind, start, end in code points (end exclusive), of every kind, weak ones too."""
    text = text_of(text_col)
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,ok:boolean>>")
    read = documents.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.xxhash64(text).alias("print"), F.flatten(F.array(*[F.coalesce(_matches(text, k), none) for k in KINDS])).alias("m"))
    rows = stash(read, label)  # one pass over the texts; it also freezes rid
    each = rows.where(F.size("m") > 0).select("rid", F.explode("m").alias("x")).select("rid", "x.*")
    upto = W.partitionBy("rid", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    parts = each.withColumn("end", end).where("ok").select("rid", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    return rows, parts


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts (rid, kind, start, end) that have every complementary class within reach, starts compared."""
    kind_class = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[1])])
    classed = parts.withColumn("cls", kind_class[F.col("kind")]).withColumn("bin", F.floor(F.col("start") / reach))
    weak = classed.where(~F.col("kind").isin(*[k for k, v in KINDS.items() if v[2]]))
    sides = classed.groupBy("rid", F.col("cls").alias("need"), F.col("bin").alias("at")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    needs = F.create_map(*[x for c, v in COMPLEMENT.items() for x in (F.lit(c), F.array(*[F.lit(y) for y in v]))])
    asked = weak.withColumn("need", F.explode(needs[F.col("cls")])).withColumn("at", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)))
    near = (F.col("at") == F.col("bin")) | ((F.col("at") < F.col("bin")) & (F.col("last") >= F.col("start") - reach)) | ((F.col("at") > F.col("bin")) & (F.col("first") <= F.col("start") + reach))
    met = asked.join(sides, ["rid", "need", "at"]).where(near)
    wanted = F.create_map(*[x for c, v in COMPLEMENT.items() for x in (F.lit(c), F.lit(len(v)))])
    held = met.groupBy("rid", "kind", "cls", "start", "end").agg(F.count_distinct("need").alias("n"))
    return held.where(F.col("n") == wanted[F.col("cls")]).select("rid", "kind", "start", "end")


def _covered(weak: DataFrame, strong: DataFrame) -> DataFrame:
    """weak without the spans that a strong span overlaps (both lists are sorted within a row by one window)."""
    both = weak.withColumn("s", F.lit(0)).unionByName(strong.withColumn("s", F.lit(1)))
    before = W.partitionBy("rid").orderBy("start", F.col("s").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("rid").orderBy("start", F.col("s").desc()).rowsBetween(W.currentRow, W.unboundedFollowing)
    seen = both.withColumn("reached", F.max(F.when(F.col("s") == 1, F.col("end"))).over(before)).withColumn("next", F.min(F.when(F.col("s") == 1, F.col("start"))).over(after))
    free = (F.col("reached").isNull() | (F.col("reached") <= F.col("start"))) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return seen.where((F.col("s") == 0) & free).select("rid", "kind", "start", "end")


def _reported(parts: DataFrame, reach: int) -> DataFrame:
    """rid, kind, start, end of the strong parts and of the linked weak ones."""
    base = parts.where(F.col("kind").isin(*[k for k, v in KINDS.items() if v[2]]))
    return base.unionByName(_covered(link_parts(parts, reach), base))


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: <id_col>, spans array<struct<start, ord, end, kind>> (base ones and linked weak ones, sorted)."""
    rows, parts = find_parts(documents, id_col, text_col)
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = _reported(parts, reach).select("rid", F.struct("start", order[F.col("kind")].alias("ord"), "end", "kind").alias("span"))
    spans = every.groupBy("rid").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("rid", "id").join(spans, "rid", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def redact_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", mask: str = "[secret]", reach: int = REACH) -> DataFrame:
    """documents with mask in place of each maximal run of reported spans, and size_col, if there is one, made right.

    A text without a span is handed on as it is. What to keep of a text is worked out on places alone; it comes back to the
    texts by a broadcast if it is small, counted before, and else by a merge join.
    """
    inner, (key, own) = numbered(documents, id_col, text_col)
    rows, parts = find_parts(inner, key, own)
    before = W.partitionBy("rid").orderBy("start", "end")
    seen = _reported(parts, reach).withColumn("prev", F.coalesce(F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    first = F.row_number().over(before) == 1
    cuts = seen.withColumn("cut", first | (F.col("start") > F.col("prev"))).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(F.col("cut"), F.struct(F.col("prev").alias("a"), F.col("start").alias("b"))))).alias("keep"), F.max("end").alias("tail")
    )
    keyed = cuts.join(rows, "rid").select("id", "print", F.struct("keep", "tail").alias("cuts"))
    found = stash(keyed.groupBy("id", "print").agg(F.min("cuts").alias("cuts")), "redactions")
    unstash(rows)
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = F.col(key).eqNullSafe(F.col("id")) & (F.xxhash64(text_of(own)) == F.col("print"))
    joined = inner.join(F.broadcast(found) if few else found.hint("merge"), same, "left")
    out = joined.withColumn(own, F.when(F.col("cuts").isNull(), F.col(own)).otherwise(_cut_out(F.col(own), F.col("cuts"), mask)))
    if size_col in documents.columns:
        size = f"c{documents.columns.index(size_col)}"
        out = out.withColumn(size, F.when(F.col("cuts").isNull(), F.col(size)).otherwise(F.length(own).cast(documents.schema[size_col].dataType)))
    return out.select(*inner.columns).toDF(*documents.columns)


def _cut_out(text: Column, cuts: Column, mask: str) -> Column:
    """What cuts keep of text, with mask between. The text is cut into blocks once, and a piece opens only the blocks that it lies in."""
    blocks = F.array(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)))

    def piece(held: Column, a: Column, n: Column) -> Column:
        block = F.floor(a / BLOCK)
        return F.substring(F.array_join(F.slice(held, (block + 1).cast("int"), (F.floor((a + n) / BLOCK) - block + 1).cast("int")), ""), (a - block * BLOCK + 1).cast("int"), n.cast("int"))

    def kept(held: Column) -> Column:
        pieces = F.transform(cuts["keep"], lambda k: piece(held, k["a"], k["b"] - k["a"]))
        return F.array_join(F.concat(pieces, F.array(piece(held, cuts["tail"], F.length(text) - cuts["tail"]))), mask)

    return F.transform(blocks, kept)[0]


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of the spans of scan_secrets()."""
    found = scan_secrets(documents, id_col, text_col)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select(F.col(id_col), *[of(k) for k in BASE], sha256_of(_joined(base)).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


