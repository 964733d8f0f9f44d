"""Facts as statements to read: groups of scope and statement, their columns, and rows with formatted values.

document_facts(context_ref, unit_ref, statement_type, label, all_values, column_labels, period_labels, extraction_order, fact_ord, ...).
A group can span many documents, so nothing collects one: columns come from the first place of each distinct label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import WS, html_escaped, number_of, text, trimmed
from factloom.functions.vocabulary import EQUITY_COLUMN_NAMES, EQUITY_COLUMNS, EQUITY_COLUMNS_BY_COUNT, SCOPE_LABELS, STATEMENT_LABELS, STATEMENT_TYPES, TOTAL_ROWS, UNIT_CAPTIONS
from factloom.operators.order import first_wins

GROUP = ["scope", "statement_type"]
SALTS = 64


def formatted(value: Column) -> Column:
    """A value as shown: grouped digits, three decimals at most, negative ones in parentheses; text without digits shows as 0."""
    t = trimmed(text(value))
    number = number_of(F.regexp_replace(t, r"[^0-9.-]", ""))
    shown = F.call_function("format_number", F.abs(number), F.lit("#,##0.###"))
    negative = (t.startswith("(") & t.endswith(")")) | (number < 0)
    return F.when(text(value) == "", "").when(t == "-", "-").when(number.isNull(), html_escaped(t)).when(negative, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def display_label(label: Column) -> Column:
    return trimmed(F.regexp_replace(text(label), f"{WS}+", " "))


def is_total(label: Column) -> Column:
    return F.regexp_replace(text(label), f"{WS}+", "").rlike(TOTAL_ROWS)


def scope_of(context_ref: Column) -> Column:
    return F.coalesce(F.nullif(F.split_part(context_ref, F.lit("_"), F.lit(1)), F.lit("")), F.lit("unknown"))


def _mapped(key: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def statement_title(scope: Column, statement_type: Column) -> Column:
    name = _mapped(statement_type, STATEMENT_LABELS)
    return F.when(scope == "unknown", name).otherwise(F.concat(_mapped(scope, SCOPE_LABELS), F.lit(" "), name))


def unit_caption(unit: Column) -> Column:
    pairs = [F.lit(x) for pair in UNIT_CAPTIONS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), unit), F.concat(F.lit("단위: "), unit))


def statement_order(scope: Column, statement_type: Column) -> Column:
    kind = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATEMENT_TYPES)), statement_type), F.lit(0)) - 1, F.lit(9))
    return (F.when(scope == "consolidated", 0).when(scope == "separate", 10).otherwise(20) + kind).cast("int")


def display_rows(document_facts: DataFrame) -> DataFrame:
    """Facts with scope, the first of those equal in reference, statement, label and order."""
    rows = first_wins(document_facts, ["context_ref", "statement_type", "label", "extraction_order"], "fact_ord")
    return rows.withColumn("scope", scope_of(F.col("context_ref")))


def groups(rows: DataFrame) -> DataFrame:
    """scope, statement_type, title, unit caption (of the first fact), n_rows, column_count, statement_order."""
    seen = F.struct("extraction_order", "fact_ord")
    count = F.max(F.size("all_values"))
    g = rows.groupBy(*GROUP).agg(F.count("*").alias("n_rows"), F.min_by("unit_ref", seen).alias("unit"), count.alias("most"))
    columns = F.when(F.col("most") < 1, 1).when(F.col("statement_type") == "equity_changes", F.col("most")).otherwise(F.least(F.lit(3), F.col("most")))
    return g.select(*GROUP, statement_title(F.col("scope"), F.col("statement_type")).alias("title"), unit_caption(F.col("unit")).alias("unit_caption"), "n_rows", columns.cast("int").alias("column_count"), statement_order(F.col("scope"), F.col("statement_type")).alias("statement_order"))


def column_label(label: Column, statement_type: Column) -> Column:
    t = trimmed(text(label))
    return F.when(statement_type == "equity_changes", _mapped(t, EQUITY_COLUMN_NAMES)).otherwise(t)


def is_suspicious(label: Column) -> Column:
    """Is the label of an equity column rather a period or a placeholder?"""
    c = F.lower(F.regexp_replace(text(label), f"{WS}+", ""))
    out = (c == "") | c.rlike(r"^20\d{2}\z") | c.isin("구분", "과목")
    for part in ("당기", "전기", "current", "prior", "period", "column"):
        out = out | c.contains(part)
    return out


def _source_labels() -> Column:
    return F.when(F.size("column_labels") > 0, F.col("column_labels")).otherwise(F.coalesce("period_labels", F.array().cast("array<string>")))


def columns_of(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """scope, statement_type, column_index, column_label: the labels first seen, as many as the group has columns.

    With too few labels columns are named by age. Equity columns with too few or suspicious labels are named by a template.
    """
    long = rows.select(*GROUP, "extraction_order", "fact_ord", F.posexplode(_source_labels()).alias("pos", "raw"))
    long = long.withColumn("column_label", column_label(F.col("raw"), F.col("statement_type"))).where("column_label != ''")
    first = long.groupBy(*GROUP, "column_label").agg(F.min(F.struct("extraction_order", "fact_ord", "pos")).alias("seen"))
    # groups are few and labels may be many: each of SALTS parts of a group keeps its own first ones, and only those meet
    dealt = first.join(grouped.select(*GROUP, "column_count"), GROUP).withColumn("salt", F.pmod(F.xxhash64("column_label"), F.lit(SALTS)))
    nth = lambda *keys: F.row_number().over(W.partitionBy(*GROUP, *keys).orderBy("seen"))
    ranked = dealt.withColumn("nth", nth("salt")).where("nth <= column_count").withColumn("nth", nth()).where("nth <= column_count")
    found = ranked.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "column_label"))), lambda x: x["column_label"]).alias("labels"))
    joined = grouped.select(*GROUP, "column_count").join(found, GROUP, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    equity = F.col("statement_type") == "equity_changes"
    good = (F.size("labels") >= F.col("column_count")) & (~equity | ~F.exists("labels", is_suspicious))
    numbers = F.sequence(F.lit(1), F.col("column_count"))
    by_age = F.transform(numbers, lambda n: F.when(n == 1, "최근 연도").when(n == 2, "직전 연도").otherwise(F.concat(n, F.lit("번째 연도"))))
    template = F.array(*map(F.lit, EQUITY_COLUMNS))
    for count, names in EQUITY_COLUMNS_BY_COUNT.items():
        template = F.when(F.col("column_count") == count, F.array(*map(F.lit, names))).otherwise(template)
    by_template = F.transform(numbers, lambda n: F.coalesce(F.get(template, n - 1), F.concat(F.lit("Column "), n)))
    labels = F.when(good, F.col("labels")).when(equity, by_template).otherwise(by_age)
    return joined.select(*GROUP, F.posexplode(labels).alias("column_index", "column_label"))


def repaired_groups(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Equity groups whose shown columns are not those that were extracted."""
    raw = rows.where("statement_type = 'equity_changes'").select(*GROUP, F.explode_outer(_source_labels()).alias("raw"))
    odd = raw.groupBy(*GROUP).agg((F.bool_or(is_suspicious(F.col("raw"))) | (F.count("raw") == 0)).alias("odd"))
    numbered = columns.groupBy(*GROUP).agg(F.bool_or(F.col("column_label").rlike(r"^Column \d+\z")).alias("numbered"))
    return odd.join(numbered, GROUP).where("odd or numbered").select(*GROUP)


def statement_cells(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The statements in long form: a row for each fact and column. Columns are few a group; facts never meet in one row."""
    values = F.coalesce("all_values", F.array(F.col("value").cast("string")))
    joined = rows.join(columns, GROUP)
    return joined.select(*GROUP, "extraction_order", "fact_ord", display_label(F.col("label")).alias("account"), is_total(F.col("label")).alias("is_total"), "column_index", "column_label", formatted(F.get(values, F.col("column_index"))).alias("shown"))


def statement_table(rows: DataFrame, width: int = 3) -> DataFrame:
    """The statements in wide form, with the first `width` values."""
    values = F.coalesce("all_values", F.array(F.col("value").cast("string")))
    return rows.select(*GROUP, "extraction_order", "fact_ord", display_label(F.col("label")).alias("account"), is_total(F.col("label")).alias("is_total"), *[formatted(F.get(values, F.lit(i))).alias(f"v{i}") for i in range(width)])
