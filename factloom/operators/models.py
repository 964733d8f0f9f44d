"""What surrounds calls of a language model: limits, admission, and falling back from one provider to the next.

No call is made here. A caller plugs one in (sources.models) or brings recorded responses as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.json import non_blank

#: Model, provider, tier, input tokens, output tokens.
MODEL_LIMITS = [
    ("gemini-2.5-flash-lite", "gemini", "speed", 1_048_576, 65_536),
    ("gemini-2.5-pro", "gemini", "quality", 1_048_576, 65_536),
    ("gemini-1.5-pro", "gemini", "quality", 2_097_152, 8_192),
    ("gpt-5.4-mini", "openai", "speed", 400_000, 128_000),
    ("gpt-4o", "openai", "quality", 128_000, 16_384),
    ("o1-preview", "openai", "quality", 128_000, 32_768),
    ("o1-mini", "openai", "speed", 128_000, 65_536),
]
#: Fixed values for models that are not listed: input tokens, output tokens.
OTHER_LIMITS = {"gemini": (1_048_576, 65_536), "openai": (128_000, 16_384)}
DEFAULT_OUTPUT = 8_192


def model_limits(spark: SparkSession, provider: str | None = None) -> DataFrame:
    table = spark.createDataFrame(MODEL_LIMITS, "model string, provider string, tier string, input_limit long, output_limit long")
    return table.where(F.col("provider") == provider) if provider else table


def estimated_tokens(prompt: Column) -> Column:
    """A fourth of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(prompt, F.lit(""))) / 4).cast("long")


def image_tokens(images: Column) -> Column:
    """Tokens of images [{width, height, base64}]: by their area, else by their encoded length."""
    one = lambda i: F.coalesce(F.ceil(i["width"] * i["height"] / 750), F.ceil(F.length(F.coalesce(i["base64"], F.lit(""))) / 1024)).cast("long")
    return F.aggregate(F.coalesce(images, F.array().cast("array<struct<width:double,height:double,base64:string>>")), F.lit(0).cast("long"), lambda s, i: s + one(i))


def admitted(requests: DataFrame) -> DataFrame:
    """requests(provider, model, prompt, extra_tokens, max_output) with estimated_input, requested_output, limits and refusal.

    refusal is "input", "output" or null. The table of limits has seven rows.
    """
    limits = F.broadcast(model_limits(requests.sparkSession).select("model", "input_limit", "output_limit"))
    joined = requests.join(limits, "model", "left")
    gemini = F.col("provider") == "gemini"
    most_in = F.coalesce("input_limit", F.when(gemini, OTHER_LIMITS["gemini"][0]).otherwise(OTHER_LIMITS["openai"][0]))
    most_out = F.coalesce("output_limit", F.when(gemini, OTHER_LIMITS["gemini"][1]).otherwise(OTHER_LIMITS["openai"][1]))
    out = joined.withColumns({"input_limit": most_in.cast("long"), "output_limit": most_out.cast("long")})
    out = out.withColumns({"estimated_input": estimated_tokens(F.col("prompt")) + F.ceil(F.coalesce("extra_tokens", F.lit(0))).cast("long"), "requested_output": F.coalesce("max_output", F.least(F.lit(DEFAULT_OUTPUT), "output_limit")).cast("long")})
    return out.withColumn("refusal", F.when(F.col("estimated_input") > F.col("input_limit"), "input").when(F.col("requested_output") > F.col("output_limit"), "output"))


def first_answers(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the answer of the first provider (by provider_ord) that gave one, else all errors, joined.

    responses(keys, provider, provider_ord, response, error); a blank response is an error. A key has as many rows as there are providers.
    """
    answer = non_blank(F.col("response"))
    error = F.when(answer.isNull(), F.concat(F.col("provider"), F.lit(": "), F.coalesce("error", F.lit("returned an empty response."))))
    got = responses.groupBy(*keys).agg(F.min(F.when(answer.isNotNull(), F.struct(F.col("provider_ord").alias("ord"), F.col("provider").alias("provider"), answer.alias("response")))).alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(error.isNotNull(), F.struct("provider_ord", error.alias("error"))))), lambda e: e["error"]), " | ").alias("errors"))
    return got.select(*keys, "best.provider", "best.response", F.when(F.col("best").isNull(), F.col("errors")).alias("errors"))


def preferred_providers(keys: dict[str, str], models: dict[str, str], first: str = "gemini") -> list[tuple[str, str]]:
    """(provider, model) of the providers that have a key, the preferred one first."""
    names = [first, *[n for n in ("gemini", "openai") if n != first]]
    return [(n, models.get(n, "")) for n in names if keys.get(n)]
