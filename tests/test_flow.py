"""From files to saved runs in one call."""

import json
import os

import pytest

from factloom.operators import history
from factloom.plans import flow
from factloom.sources import calls, documents
from factloom.sources import history as store

BALANCE = "재무상태표\n(단위: 천원)\n2024.12.31 현재\n자산총계 1,000 2,000\n부채총계 1,600 1,200\n자본총계 1,400 1,800"
PROVIDERS = [("gemini", "gemini-1.5-pro"), ("openai", "gpt-4o")]


@pytest.fixture()
def decoder():
    def decode(content):
        """A "PDF" of text: pages parted by form feeds, each word of a line an item."""
        for page, text in enumerate(content.decode().split("\f"), 1):
            if text.startswith("broken"):
                raise ValueError("no report")
            n = 0
            for k, line in enumerate(text.split("\n")):
                for m, word in enumerate(line.split(" ")):
                    yield page, n, word, 60.0 + 110.0 * m, 800.0 - 14.0 * k, 40.0, 10.0
                    n += 1

    return decode


def upload(tmp_path, **files):
    (tmp_path / "in").mkdir(exist_ok=True)
    for name, text in files.items():
        (tmp_path / "in" / f"{name}.pdf").write_bytes(text.encode())
    return f"file://{tmp_path}/in"


def by_name(rows):
    return {r["document_id"].rpartition("/")[2]: r for r in rows}


def test_files_to_saved_runs_without_models(spark, tmp_path, decoder):
    path, saved, work = upload(tmp_path, a=BALANCE, b=BALANCE.replace("1,400", "1,401"), bad="broken"), f"file://{tmp_path}/history", f"file://{tmp_path}/work"
    got = flow.process(spark, path, decoder, f"{work}1", "r1", saved)
    assert {n: r["status"] for n, r in by_name(got["reviews"].collect()).items()} == {"a.pdf": "error", "b.pdf": "error"}
    labels = sorted((r["document_id"].rpartition("/")[2], r["label"], r["value"]) for r in got["facts"].collect())
    assert labels[:3] == [("a.pdf", "부채총계", 1.6e6), ("a.pdf", "자본총계", 1.4e6), ("a.pdf", "자산총계", 1e6)] and len(labels) == 6
    assert got["issues"].count() == 2
    log = {(r["document_id"].rpartition("/")[2], r["step"]): (r["level"], r["message"]) for r in got["log"].collect()}
    assert log["bad.pdf", "upload"] == ("error", "upload failed. ValueError: no report") and log["a.pdf", "history"] == ("info", "saved")
    whole = json.loads("".join(t for _, t in sorted((r["name"], r["text"]) for r in documents.read_parts(spark, f"{work}1/document").collect())))
    assert len(whole["facts"]) == 6
    run = next(r["id"] for r in store.load(spark, saved).collect() if r["filename"] == "a.pdf")
    assert store.found_by(spark, saved, run, "facts", "label string, value double").count() == 3
    assert {r["filename"]: (r["n_candidates"], r["n_facts"], r["report_types"]) for r in store.load(spark, saved).collect()} == {"a.pdf": (1, 3, ["unknown"]), "b.pdf": (1, 3, ["unknown"])}
    again = flow.process(spark, upload(tmp_path, c=BALANCE), decoder, f"{work}2", "r2", saved)
    assert list(by_name(again["documents"].collect())) == ["c.pdf"]
    assert {r["filename"] for r in store.load(spark, saved).collect()} == {"a.pdf", "b.pdf", "c.pdf"}


def test_models_refine_and_read_and_a_second_start_pays_nothing(spark, tmp_path, decoder):
    (tmp_path / "log").mkdir()
    log = f"{tmp_path}/log"

    def caller(provider, model, prompt):
        kind = "segments" if '"segments"' in prompt else "structure"
        open(f"{log}/{len(os.listdir(log)):04d}-{kind}-{provider}", "w").close()
        if provider == "gemini":
            raise ValueError("down")
        if kind == "segments":
            return json.dumps({"segments": [{"statement_type": "balance_sheet", "scope": "separate", "start_page": 1, "end_page": 1, "confidence": 0.9}]})
        return json.dumps({"unit": "won", "columns": [{"key": "2024", "label": "당기"}], "rows": [{"order": 1, "label": "자산총계", "value_cells": {"2024": {"page": 1, "row_index": 3, "cell_indices": [1]}}}]})

    path, work = upload(tmp_path, a=BALANCE + "\f" + "끝"), f"file://{tmp_path}/work"
    fast = calls.Policy(wait=0.0, tasks=2)
    got = flow.process(spark, path, decoder, f"{work}1", "r", caller=caller, providers=PROVIDERS, policy=fast)
    assert [(r["scope"], r["start_page"], r["end_page"]) for r in got["candidates"].collect()] == [("separate", 1, 1)]
    assert [(r["label"], r["value"], r["scope"]) for r in got["facts"].collect()] == [("자산총계", 1000.0, "separate")]
    assert sorted(f[5:] for f in os.listdir(log)) == ["segments-gemini", "segments-openai", "structure-openai"]  # gemini admits no structure: its output is too short
    flow.process(spark, path, decoder, f"{work}1", "r", caller=caller, providers=PROVIDERS, policy=fast)
    assert len(os.listdir(log)) == 3


def test_an_empty_folder(spark, tmp_path, decoder):
    got = flow.process(spark, upload(tmp_path), decoder, f"file://{tmp_path}/work", "r", f"file://{tmp_path}/history")
    assert [got[k].count() for k in ("documents", "candidates", "facts", "log")] == [0, 0, 0, 0]
    assert history.listing(store.load(spark, f"file://{tmp_path}/history")).count() == 0
