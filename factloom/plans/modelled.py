"""Extraction with language models, end to end, around whatever answers them.

Every request is a row and every answer is a row: requests(keys, provider_ord, provider, model, prompt) go through admission, a caller
(sources.calls, which asks a request's providers in turn) or a table of recorded answers. An answer that is missing, blank, no JSON or
empties itself leaves what was there before - the heuristic spans, or the facts of the next tier - for its document or span alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import spans
from factloom.operators.spans import broad_pages, broad_range, normal_segments
from factloom.operators.structure import CANDIDATE, structure_facts, vision_facts
from factloom.plans.pipeline import extracted
from factloom.sources.calls import Policy, answered
from factloom.sources.models import Caller, segment_prompts, structure_prompts, vision_prompts

Providers = list[tuple[str, str]]  # (provider, model), the preferred one first


def requests(prompts: DataFrame, providers: Providers, max_output: int, extra_tokens: str | None = None) -> DataFrame:
    """prompts for each provider in turn. extra_tokens: the column that counts tokens beside the prompt's, such as those of images."""
    listed = F.array(*[F.struct(F.lit(n).alias("provider_ord"), F.lit(p).alias("provider"), F.lit(m).alias("model")) for n, (p, m) in enumerate(providers)])
    each = prompts.withColumn("p", F.explode(listed)).select(*prompts.columns, "p.*").withColumn("max_output", F.lit(max_output).cast("long"))
    return each.withColumn("extra_tokens", F.col(extra_tokens).cast("long") if extra_tokens else F.lit(0).cast("long"))


def answers(asked: DataFrame, keys: list[str], caller: Caller, ledger: str | None = None, policy: Policy | None = None, run: str | None = None) -> DataFrame:
    """keys, provider, response, errors: of the first provider that admits the request and answers it; those behind it are not asked.

    The calls are made here and kept in a ledger (sources.calls), so what is made of the answers can be worked out any number of times.
    """
    return answered(asked, keys, caller, ledger, policy, run)


def segment_requests(pages: DataFrame, documents: DataFrame, candidates: DataFrame, toc_checks: DataFrame, providers: Providers, max_pages: int = 100) -> DataFrame:
    return requests(segment_prompts(broad_pages(pages, broad_range(documents, candidates, toc_checks), max_pages), candidates), providers, 8_192)


def refined(candidates: DataFrame, documents: DataFrame, responses: DataFrame) -> DataFrame:
    """Spans narrowed by the segments of responses(document_id, response); documents without a usable segment keep theirs."""
    return spans.refined(candidates, normal_segments(responses.select("document_id", "response"), documents))


def structure_requests(evidence: DataFrame, candidates: DataFrame, providers: Providers) -> DataFrame:
    return requests(structure_prompts(evidence, candidates), providers, 16_384)


def vision_requests(candidates: DataFrame, documents: DataFrame, image_tokens: DataFrame, providers: Providers) -> DataFrame:
    """image_tokens(document_id, candidate_ord, tokens): what the rendered pages of a span count for (operators.models.image_tokens)."""
    prompts = vision_prompts(candidates, documents).join(image_tokens, CANDIDATE)
    return requests(prompts, providers, 16_384, "tokens")


def modelled(pages: DataFrame, documents: DataFrame, candidates: DataFrame, cells: DataFrame, vision: DataFrame | None = None, structure: DataFrame | None = None) -> DataFrame:
    """Facts of confirmed spans: of the page images where a model read any, else of the cells it pointed to, else of the text.

    vision, structure: answers(document_id, candidate_ord, response). A span's failed answer has no rows, so the span falls to the
    next tier; other spans are untouched.
    """
    confirmed = candidates.where("include")
    tiers = []
    for responses, read in ((vision, lambda r: vision_facts(r, confirmed, documents)), (structure, lambda r: structure_facts(r, cells, confirmed, documents))):
        if responses is not None:
            tiers.append(read(responses.join(confirmed.select(*CANDIDATE), CANDIDATE, "left_semi").select(*CANDIDATE, "response")))
    return extracted(pages, candidates, documents, *tiers)
