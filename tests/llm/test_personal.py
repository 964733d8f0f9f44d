import hashlib
import random
import re
import time

from factloom.llm import personal as P
from factloom.llm.personal import KINDS, LEAST_INSTANCE, LEAST_PATTERN, LEAST_SEEDS, base_spans, bootstrap, emails, personal_report, personal_spans, unknown_spans

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if n % 2 else int(c) for n, c in enumerate(d[::-1])) % 10 == 0


def ok(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if ok(k, m))


TEXTS = [
    None, "", "é😀 a.b@c.example.com, x@y z@.q @w.com a@b.c@d.e a@b.com_x@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 12-34",
    "+1 (017) 555-7713 +44 20 7946 0958. +12 +1-----2 ++49 30 123456", "5500005555555559" * 3, "a@b.c" * 500,
]


def test_base_spans_equal_brute_force():
    rnd = random.Random(2)
    mixed = ["".join(rnd.choice(["a", "@", ".", "1", "4", "+", " ", "-", "b.c", "25", "(", "_", "é", "4111111111111111"]) for _ in range(60)) for _ in range(3000)]
    for text in TEXTS + mixed:
        assert base_spans(text or "") == brute(text), text


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 10**6, "a" * 10**6 + "@", "1" * 10**6, "1." * 500_000, "@" * 10**6, "+1" * 500_000, "1 " * 500_000):
        base_spans(text)
        list(emails(text))
        list(unknown_spans(text, []))
    assert time.time() - began < 30


def test_report(docs):
    rows = {r.doc_id: r for r in personal_report(docs(TEXTS)).collect()}
    for n, text in enumerate(TEXTS):
        want = brute(text)
        assert [rows[n][f"n_{k}"] for k in KINDS] == [sum(s[3] == k for s in want) for k in KINDS]
        assert rows[n].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()


def test_patterns_of_seeds_discover_unseen_identifiers(docs):
    texts = [f"please call phone number +1 (555) 010-{1000 + n} today" for n in range(8)]
    texts += ["please call phone number 555-0199x7 today", "the room 555-0199x8 is open", "a lone AB-12345 token", "please call phone number " + "no_one" * 20 + " today"]
    spans = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in personal_spans(docs(texts)).collect()}
    assert spans[8] == [("seen_phone", 25, 35)] and spans[9] == spans[10] == [] and spans[11] == [("seen_phone", 25, 145)]
    assert all(spans[n][0][0] == "phone" and len(spans[n]) == 1 for n in range(8))


def test_evidence_is_distinct_and_edge_tables_work(docs):
    texts = ["please call phone number +1 (555) 010-1000 today"] * 9 + ["please call phone number 555-0199x7 today"]
    assert all(not any(s["kind"].startswith("seen") for s in r.spans) for r in personal_spans(docs(texts)).collect())
    assert personal_report(docs([])).count() == 0
    assert sorted((r.doc_id or -1, r.n_ip) for r in personal_report(docs(["1.2.3.4"] * 3, [None, 1, 1])).collect()) == [(-1, 1), (1, 1), (1, 1)]


def brute_patterns(found):
    """Rounds over the whole graph until nothing is new."""
    slots = {}
    for value, _, pattern in found:
        slots.setdefault(pattern, set()).add(value)
    known = {(v, k): 1.0 for v, k, _ in found if k}
    unknown = {(p, v) for v, k, p in found if not k}
    believed, before, rounds = known, -1, 0
    while True:
        confident = {}
        for p, values in slots.items():
            for kind in KINDS:
                own = [believed[v, kind] for v in values if (v, kind) in believed]
                if len(own) >= LEAST_SEEDS and sum(own) / len(values) >= LEAST_PATTERN:
                    confident[p, kind] = sum(own) / len(values)
        doubt = {}
        for p, v in unknown:
            for kind in KINDS:
                if (p, kind) in confident:
                    doubt[v, kind] = doubt.get((v, kind), 1) * max(1 - confident[p, kind], 1e-6)
        seen = {x: 1 - d for x, d in doubt.items() if 1 - d >= LEAST_INSTANCE}
        rounds += 1
        if sum(confident.values()) - before < 1e-9:
            return confident, seen, rounds
        before, believed = sum(confident.values()), known | seen


def test_scores_of_patterns_equal_brute_force(spark):
    rnd = random.Random(4)
    found = [(f"v{rnd.randrange(60)}", None, f"p{rnd.randrange(12)}") for _ in range(60)]
    found += [(f"s{n}", rnd.choice(["ip", "ip", "phone"]), f"p{rnd.randrange(12)}") for n in range(110)]
    # a chain: seeds make p20 confident, that v100 to v103, these p21, that v110 and on
    found += [(f"t{n}", "email", "p20") for n in range(20)] + [(f"v{100 + n}", None, p) for n in range(3) for p in ("p20", "p21")] + [("v110", None, "p21"), ("v110", None, "p20")]
    want, seen, rounds = brute_patterns(found)
    assert rounds > 2 and ("v110", "email") in seen and ("p21", "email") in want
    got = {(r.pattern, r.kind): r.confidence for r in bootstrap(spark.createDataFrame(found * 2, "value string, kind string, pattern string")).collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-4 for x in want)


def test_patterns_are_made_of_whole_words():
    long = "q" * 200
    assert P.patterns(f"call {long} x1 {long} end", 206, 208) == [f"{long} _ {long}"]
    text = "intro " + "a" * 30 + " " + "b" * 30 + " x1 c"
    assert P.patterns(text, 68, 70)[0] == "a" * 30 + " " + "b" * 30 + " _"
    assert P.patterns("x1", 0, 2) == [] and P.patterns("a b x1", 4, 6) == ["a b _"]
