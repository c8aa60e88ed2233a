"""Personal data: the fixed patterns, the sums over all labelled spans, and the field as a whole."""

import itertools
import math
import random
import re
import time

import numpy as np
import pytest

from carelake.llm import personal

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [sum(divmod(2 * d, 10)) if n % 2 else d for n, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(a, k, b) for a, _, k, b in sorted(
        (m.start(), n, k, m.end()) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(k, m[0]))]


def test_base_spans():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x", ".", ".com", " ", "-", "+", "1", "22", "255", "256", "0001", "4111111111111111", "(", ")",
             "é", "\n", "+1 (017) 555-7713", "10.0.0.1", "4111 1111 1111 1111", "%", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert personal.base_spans(text) == plain(text), text


def test_no_text_takes_quadratic_time():
    start = time.time()
    field = personal.Field({"card any": 1.0}, np.zeros((5, 5)), frozenset())
    for text in ("a" * 300_000 + " 1", "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "1 " * 50_000, "at dot " * 20_000,
                 "(1" * 50_000):
        personal.all_spans(text, field)
    assert time.time() - start < 60


def sequences(spans, first, last):
    """Every way to cover the places with spans and single places outside."""
    if first == last:
        yield []
        return
    for s in [(first, first + 1, 0, 0.0), *(s for s in spans if s[0] == first)]:
        for rest in sequences(spans, s[1], last):
            yield [s, *rest]


@pytest.mark.parametrize("seed", range(12))
def test_best_and_expected_are_those_of_all_sequences(seed):
    rng = random.Random(seed)
    size = 3
    steps = np.array([[rng.gauss(0, 1) for _ in range(size)] for _ in range(size)])
    spans = sorted({(i, j, rng.randrange(1, size)): rng.gauss(0.5, 2) for i, j in itertools.combinations(range(7), 2)
                    if rng.random() < 0.5}.items())
    spans = [(*k, v) for k, v in spans] or [(0, 1, 1, 0.3)]
    first, last = min(s[0] for s in spans), max(s[1] for s in spans)
    scored = []
    for way in sequences(spans, first, last):
        labels = [0, *(s[2] for s in way), 0]
        scored.append((sum(s[3] for s in way) + sum(steps[a, b] for a, b in zip(labels, labels[1:])), way, labels))
    best = max(scored, key=lambda w: w[0])
    assert personal.best_spans(spans, steps) == [s[:3] for s in best[1] if s[2]]
    total, chance, moved = personal.expected(spans, steps)
    whole = math.log(sum(math.exp(s) for s, _, _ in scored))
    assert total == pytest.approx(whole)
    for n, s in enumerate(spans):
        assert chance[n] == pytest.approx(sum(math.exp(v - whole) for v, way, _ in scored if s in way))
    seen = np.zeros((size, size))
    for v, _, labels in scored:
        for a, b in zip(labels, labels[1:]):
            seen[a, b] += math.exp(v - whole)
    assert moved == pytest.approx(seen)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = digits(15)
        return next(body + c for c in "0123456789" if personal.luhn(body + c))
    made, decoys = [], []
    for _ in range(120):
        words = [rng.choice(["the", "call", "und", "le", "noch", "river", "see", "été"]) for _ in range(30)]
        made.append(" ".join([*words[:9], rng.choice([f"{words[0]}.{digits(2)}@mail{digits(1)}.example.com", card(),
                    f"+1 ({digits(3)}) 555-{digits(4)}", ".".join(str(rng.randrange(256)) for _ in range(4))]), *words[9:]]))
        wrong = digits(15)
        decoys.append(" ".join([*words[:9], rng.choice([f"version {digits(1)}.{digits(1)}", f"in {2000 + rng.randrange(30)}.",
                      next(wrong + c for c in "0123456789" if not personal.luhn(wrong + c)), "page 12 of 300"]), *words[9:]]))
    return made, decoys


@pytest.fixture(scope="module")
def field(texts):
    return personal.train([*texts[0][::2], *texts[1][::2]])


def test_held_out(texts, field):
    found = [{(a, personal.TYPES[y - 1], b) for a, b, y in field.spans(t)} for t in texts[0][1::2]]
    assert sum(set(plain(t)) <= f for t, f in zip(texts[0][1::2], found)) >= 0.95 * len(found)  # the field by itself
    assert all(personal.all_spans(t, field) == [] for t in texts[1][1::2])
    told = {"mail jo.doe at mail dot example dot com please": "crf_email", "see 10[.]0[.]0[.]7 there": "crf_ip",
            "the card 4111.1111.1111.1111 here": "crf_card", "call (212) 555-0199 now": "crf_phone"}
    for text, kind in told.items():
        assert [k for k, _, _ in personal.all_spans(text, field)] == [kind], text


def test_only_stretches_are_searched_and_nothing_is_lost(texts, field):
    rng = random.Random(9)
    for _ in range(40):
        text = " ".join(rng.choice(texts[0]) for _ in range(4)) + " at mail dot example dot com" + rng.choice(["", " (at) ", "\n"])
        t = personal._Tokens(text, 0, len(text))
        whole = [(t.starts[i], t.ends[j - 1], y) for run in personal.clusters(personal.candidates(t, field.words))
                 for i, j, y in field.decode(run)]
        assert field.spans(text) == whole


def test_base_spans_stay_and_no_other_overlaps_them(texts, field):
    for text in [a + b for a, b in zip(*texts)] + ["+1 826 555-4081 190.137.2.9 4111111111111111 4111111111111112"]:
        base, got = plain(text), personal.all_spans(text, field)
        assert [(a, k, b) for k, a, b in got if k in personal.TYPES] == base
        assert all(y <= a or x >= b for k, a, b in got if k not in personal.TYPES for x, _, y in base)
        assert got == sorted(got, key=lambda s: (s[1], personal.KINDS.index(s[0])))


def test_tables(spark, field):
    rows = [(1, None), (2, ""), (2, "a@b.co"), (2, "a@b.co"), (None, "x" * 200_000 + " +49 30 1234567"), (3, "none"), (4, "1" * 50_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, start int").repartition(2)
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in personal.find_personal(docs, field).collect()), key=repr)
    assert got == sorted(((i, personal.all_spans(t or "", field)) for i, t in rows), key=repr)
    empty = docs.limit(0)
    assert personal.sample_texts(empty) == [] and personal.find_personal(empty, personal.train([])).collect() == []
    parts = personal.sample_texts(docs)
    assert sum("a@b.co" in p for p in parts) == 1 and all(len(p) <= 4 * personal.AROUND for p in parts)
    assert personal.all_spans("a at b dot com, a@b.co", personal.train([])) == [("email", 16, 22)]
