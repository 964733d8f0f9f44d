import random
import re

import duckdb
import pytest

from factloom.llm import licenses as L


def brute(text, least=L.LEAST_DICE):
    text = text or ""
    found = {}
    units = [L.normal_words(u) for u in {*re.split("[\r\n]+", text), *re.split("(?:\r?\n[ \t]*){2,}", text), text}]
    every = L.normal_words(text)
    for name, template in L.TEMPLATES.items():
        tw = L.normal_words(template)
        order = list(zip(tw, tw[1:], strict=False))
        t = set(order)
        anchors = set(L.anchor_words(sorted(" ".join(g) for g in t), least))
        at = [p - order.index(g) for p, g in enumerate(zip(every, every[1:], strict=False)) if g in t and anchors & set(g)]
        for words in units + [every[max(0, s) : s + len(tw)] for s in at]:
            own = set(zip(words, words[1:], strict=False))
            if not own:
                continue
            dice = 2 * len(own & t) / (len(own) + len(t))
            if dice >= least:
                found[name] = max(found.get(name, 0), dice)
    return found


def texts():
    rnd = random.Random(6)
    out = [None, "", "word", "license license license", "LICENSED under CC BY-NC 4.0 " * 30, "é Licensed under the Apache License, Version 2.0.", "x" * 100_000, "a Licence under the MIT licence.", "SPDX-LICENCE-identifier: mit"]
    for _ in range(150):
        words = rnd.choice(list(L.TEMPLATES.values())).split()
        for _ in range(rnd.randrange(0, 6)):
            at = rnd.randrange(max(1, len(words)))
            words[at : at + rnd.choice([0, 1, 2])] = rnd.choice([[], ["zz"], ["the"], ["a\n"], ["b\n\n"]])
        out.append(rnd.choice(["", "intro words\n", "intro "]) + rnd.choice([" ", "\n"] if rnd.random() < 0.2 else [" "]).join(words or ["x"]) + rnd.choice(["", "\nend", " tail of words"]))
    return out


@pytest.fixture(scope="module")
def cases():
    return texts()


def test_matches_equal_brute_force(docs, cases):
    rows = {r.doc_id: {m["name"]: m["dice"] for m in r.matches} for r in L.license_matches(docs(cases)).collect()}
    assert len(rows) == len(cases) and sum(map(len, rows.values())) > 60
    for n, text in enumerate(cases):
        assert rows[n] == pytest.approx(brute(text)), n


def test_report_equals_its_sql(docs, cases):
    table = docs(cases, [n // 2 if n % 7 else None for n in range(len(cases))])
    documents = table.toPandas()  # noqa: F841
    want = duckdb.sql(L.report_sql()).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, L.license_report(table).collect()), key=key) == sorted(want, key=key)


def test_every_template_finds_itself_and_its_anchors_can_not_be_missed():
    assert all(brute(v)[k] == 1 for k, v in L.TEMPLATES.items())
    for t in L.prepared(L.TEMPLATES, L.LEAST_DICE).values():
        rest = len(t.bigrams) - len(t.anchors)
        assert t.anchors and 2 * rest < L.LEAST_DICE * (rest + len(t.bigrams))


def test_notices_inside_lines_wrapped_and_in_comments_are_found(docs):
    prose = "some words of prose " * 30
    texts = [prose + "Released under the MIT License. " + prose, prose + "\nLicensed under the Apache License,\nVersion 2.0. " + prose]
    texts += ["\n".join(" * " + line for line in re.findall(".{1,60}(?: |$)", L.TEMPLATES[k])) + "\n */ int main() {} " + prose for k in ("mit-text", "bsd-3-clause-text", "gpl-3.0", "apache-2.0-notice")]
    found = [{m["name"]: m["dice"] for m in r.matches} for r in L.license_matches(docs(texts)).orderBy("doc_id").collect()]
    for names, k in zip(found, ("mit-named-line", "apache-2.0-line", "mit-text", "bsd-3-clause-text", "gpl-3.0", "apache-2.0-notice"), strict=True):
        assert names[k] == 1, (k, names)


def test_short_references_and_openings_are_found(docs):
    prose = "some words of prose " * 30
    cases = {"Licensed under the MIT licence": "mit", "SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: Apache-2.0": "apache-2.0", "distributed under the GNU General Public License version 2": "gpl-2.0", "released under the GPL v3 or later": "gpl-3.0", "under the terms of the BSD 3-Clause License": "bsd-3-clause", "see the Mozilla Public License 2.0": "mpl-2.0"}
    cases["GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n Preamble"] = "gpl-3.0"
    texts = [f"{a}{text}{b}" for text in cases for a, b in (("", ""), (prose, " " + prose))]
    best = [r.best_license or "" for r in L.license_report(docs(texts)).orderBy("doc_id").collect()]
    assert [b.startswith(w) for b, w in zip(best, [w for w in cases.values() for _ in range(2)], strict=True)] == [True] * len(texts), best
    assert not any(r.n_licenses for r in L.license_report(docs(["the general public may see version 2 of it", "a mit glove under the table", "later the gpl or v3"])).collect())


def test_empty_table(docs):
    assert L.license_report(docs([])).count() == 0
