"""Calls of models through the ledger: how many are made, in which order, and what a second try pays."""

import os

import pytest

from factloom.sources import calls

ASKED = "k long, provider_ord int, provider string, model string, prompt string, extra_tokens long, max_output long"
FAST = calls.Policy(wait=0.0, tasks=2)


def asked(spark, prompts, providers=(("gemini", "gemini-2.5-pro"), ("openai", "gpt-4o"))):
    return spark.createDataFrame([(k, n, p, m, prompt, 0, 100) for k, prompt in enumerate(prompts) for n, (p, m) in enumerate(providers)], ASKED)


def logging_caller(folder, behave):
    """A caller that leaves a file for each call, as it runs in other processes."""

    def call(provider, model, prompt):
        calls_so_far = len([f for f in os.listdir(folder) if f.startswith(f"{provider}+{prompt}+")])
        open(f"{folder}/{provider}+{prompt}+{calls_so_far}", "w").close()
        return behave(provider, prompt, calls_so_far)

    return call


def made(folder):
    found = {}
    for name in os.listdir(folder):
        provider, prompt, _ = name.split("+")
        found[provider, prompt] = found.get((provider, prompt), 0) + 1
    return found


def told(df):
    return {r["k"]: (r["provider"], r["response"], r["errors"]) for r in df.collect()}


@pytest.fixture()
def place(tmp_path):
    (tmp_path / "log").mkdir()
    return f"{tmp_path}/log", f"file://{tmp_path}/ledger"


def test_the_first_answer_ends_a_request(spark, place):
    log, ledger = place

    def behave(provider, prompt, n):
        if provider == "gemini" and prompt == "bad":
            raise ValueError("no such model")
        if provider == "gemini" and prompt == "busy" and n < 2:
            raise calls.Passing("busy")
        return " \ufeff" if prompt == "blank" else f"{provider} {prompt}"

    rows = asked(spark, ["good", "bad", "busy", "blank"])
    got = told(calls.answered(rows, ["k"], logging_caller(log, behave), ledger, FAST))
    assert got == {0: ("gemini", "gemini good", None), 1: ("openai", "openai bad", None), 2: ("gemini", "gemini busy", None), 3: (None, None, "gemini: returned an empty response. | openai: returned an empty response.")}
    assert made(log) == {("gemini", "good"): 1, ("gemini", "bad"): 1, ("openai", "bad"): 1, ("gemini", "busy"): 3, ("gemini", "blank"): 1, ("openai", "blank"): 1}


def test_answers_are_worked_out_again_without_calls_and_kept_for_later_runs(spark, place):
    log, ledger = place
    caller = logging_caller(log, lambda provider, prompt, n: prompt if prompt != "later" or n else " ")
    rows = asked(spark, ["a", "later"], [("gemini", "gemini-2.5-pro")])
    got = calls.answered(rows, ["k"], caller, ledger, FAST)
    assert [told(got) for _ in range(3)] == [{0: ("gemini", "a", None), 1: (None, None, "gemini: returned an empty response.")}] * 3
    assert made(log) == {("gemini", "a"): 1, ("gemini", "later"): 1}
    calls.compact(spark, ledger)
    assert told(calls.answered(rows, ["k"], caller, ledger, FAST)) == {0: ("gemini", "a", None), 1: ("gemini", "later", None)}
    assert made(log) == {("gemini", "a"): 1, ("gemini", "later"): 2}
    other = asked(spark, ["a"], [("openai", "gpt-4o")])  # another model's answer is not this one's
    assert told(calls.answered(other, ["k"], caller, ledger, FAST)) == {0: ("openai", "a", None)}


def test_a_task_that_dies_pays_nothing_twice(spark, place):
    log, ledger = place
    prompts = [f"p{k}" for k in range(20)]

    def dying(provider, prompt, n):
        if prompt == "p7" and n == 0:
            os._exit(1)  # the worker goes without a word
        if prompt == "p9" and n < 2:
            raise TimeoutError("slow")
        return prompt

    rows, caller = asked(spark, prompts), logging_caller(log, dying)
    policy = calls.Policy(wait=0.0, tasks=1)
    with pytest.raises(Exception, match="crashed|exited|Worker|EOF"):
        calls.answered(rows, ["k"], caller, ledger, policy, run="r")
    assert told(calls.answered(rows, ["k"], caller, ledger, policy, run="r")) == {k: ("gemini", p, None) for k, p in enumerate(prompts)}
    assert made(log) == {("gemini", p): {"p7": 2, "p9": 3}.get(p, 1) for p in prompts}


def test_a_request_that_comes_twice_is_asked_once(spark, place):
    log, ledger = place

    def behave(provider, prompt, n):
        raise ValueError("no")

    rows = asked(spark, ["a"])
    assert told(calls.answered(rows.unionAll(rows), ["k"], logging_caller(log, behave), ledger, FAST)) == {0: (None, None, "gemini: no | openai: no")}
    assert made(log) == {("gemini", "a"): 1, ("openai", "a"): 1}


def test_refusals_cost_no_call_and_attempts_are_bounded(spark, place):
    log, ledger = place

    def behave(provider, prompt, n):
        raise ConnectionError("down")

    rows = spark.createDataFrame([(1, 0, "gemini", "gemini-1.5-pro", "x", 0, 9_000), (1, 1, "openai", "gpt-4o", "x", 0, 9_000), (2, 0, "openai", "gpt-4o", "y", 200_000, 1)], ASKED)
    got = told(calls.answered(rows, ["k"], logging_caller(log, behave), ledger, calls.Policy(attempts=2, wait=0.0, flush=50)))
    assert got == {1: (None, None, "gemini: refused: output tokens | openai: down"), 2: (None, None, "openai: refused: input tokens")}
    assert made(log) == {("openai", "x"): 2}


def test_calls_begin_at_most_so_often():
    import time

    pace, began = calls._Pace(50), time.monotonic()
    for _ in range(6):
        pace.wait()
    assert time.monotonic() - began >= 0.1
