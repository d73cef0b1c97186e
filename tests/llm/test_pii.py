"""Personal data: fixed kinds against their patterns, decoding against the plain algorithm, held-out sentences."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tabwise.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.fixture(scope="module")
def field():
    return pii.fit()


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), m.end(), kind))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    seen = set()
    for _ in range(6000):
        parts = [rng.choice("ab@@..+-% 1234567890()é\n") for _ in range(rng.randint(0, 30))]
        parts += [rng.choice(["4111 1111-1111 1111", "10.0.0.256", "1.2.3.4.5", "a@b.c", "a.b@c-d.e.f@g.h", "+1 (569) 555-7279", "0010.1.1.001", "٣٤"]) for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        text = "".join(parts)
        got = sorted(pii.base_spans(text))
        assert got == brute_base(text), text
        seen |= {k for _, _, k in got}
    assert seen == set(PATTERNS)


@pytest.mark.parametrize("at_once", [8, 100_000])
def test_decode_matches_plain_viterbi(at_once, monkeypatch):
    monkeypatch.setattr(pii, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 60, 400):
        for spread in (0.3, 1.5, 4.0):
            tables, moves = rng.normal(0, spread, (7, 12, 4)), rng.normal(0, 1, (4, 4))
            tables[:, :, 0] += spread
            classes = np.concatenate([np.zeros(3, int), rng.integers(1, 12, n), np.zeros(3, int)])
            scores = pii.emissions(tables, classes)
            best, back = scores[0], []
            for t in range(1, len(scores)):
                ways = best[:, None] + moves
                back.append(ways.argmax(0))
                best = ways.max(0) + scores[t]
            path = [0]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert pii.decode(tables, classes, moves, at_once).tolist() == path[::-1]


def test_expectations_match_enumeration():
    rng = np.random.default_rng(1)
    e, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    paths = list(itertools.product(range(3), repeat=4))
    weight = np.array([np.exp(sum(e[0, t, p[t]] for t in range(4)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
    weight /= weight.sum()
    both, pairs = pii._expectations(e, moves)
    want = sum(w * sum(np.eye(3)[a][:, None] * np.eye(3)[b] for a, b in zip(p, p[1:])) for w, p in zip(weight, paths))
    assert np.allclose(pairs, want)
    assert np.allclose(both[0, 2], [sum(w for w, p in zip(weight, paths) if p[2] == y) for y in range(3)])


HELD_OUT = [
    "My name is [name:Wanda Kruger] and I work there.",
    "Dr. [name:Maria Lopez] called again",
    "Name: [name:Peter Stone]",
    "I live at [address:12 Oak Street] with them",
    "SSN: [id:123-45-6789]",
    "social security number is [id:733-18-4402], keep it",
    "Date of birth: [birth:01/02/1980]",
    "geboren am [birth:12.11.1969] in der",
    "call me at [phone:(569) 555-7279] now",
    "phone: [phone:212-555-0111] after",
    "write to [mail:bob dot smith at mail dot com] please",
    "account number [account:1122 3344 5566] was closed",
    "and of the [account:4035787455641872] in then",
    "IBAN [account:GB29 NWBK 6016 1331 9268 19] belongs",
]
CLEAN = [
    "The of and. In that is, with the of then\nIt was. And so on of the.",
    "Licensed under the Apache License, Version 2.0.",
    "For For For For For For for the the the",
    "version 4 of 12 in 1999 and 2.1",
    "on thst | nterti | wh 14 | in",
]


def test_held_out_sentences(field):
    finder = pii.Finder(field)
    hit = 0
    for line in HELD_OUT:
        text, spans = pii.parse(line)
        hit += finder.spans(text.encode()) == spans
    assert hit >= 0.8 * len(HELD_OUT)
    assert [finder.spans(t.encode()) for t in CLEAN] == [[]] * len(CLEAN)
    rows = [pii.parse(r) for r in pii.LABELLED]
    assert sum([s for s in finder.spans(t.encode()) if s[2] in pii.DIGITS] == own for t, own in rows) >= 0.95 * len(rows)


def test_chain_is_the_same_alone_and_among_others(field):
    texts = [pii.parse(r)[0].encode() for r in pii.LABELLED]
    alone, among = pii.Finder(field), pii.Finder(field)
    among.prepare(texts)
    assert [among.spans(t) for t in texts] == [alone.spans(t) for t in texts]


def test_long_text_is_whole(field, monkeypatch):
    filler = "the of and in that is with, of then. " * 6000
    text, spans = pii.parse("my name is [name:Wanda Kruger] and of")
    whole = filler + text + " " + filler + "+1 (569) 555-7279"
    want = [(len(filler) + a, len(filler) + b, k) for a, b, k in spans] + [(len(whole) - 17, len(whole), "phone")]
    assert pii.Finder(field).spans(whole.encode()) == want
    monkeypatch.setattr(pii, "AT_ONCE", 50)
    assert pii.Finder(field).spans(whole.encode()) == want


def test_report(spark, docs, nothing, field):
    more = docs.select("doc_id", "text", "label", "fp").unionByName(spark.createDataFrame([(900 + i, pii.parse(r)[0] + " a@b.cd 10.0.0.1", "x", "y") for i, r in enumerate(pii.LABELLED)], "doc_id long, text string, label string, fp string"))
    rows = pii.report(more, field).collect()
    texts = {r.doc_id: r.text or "" for r in more.collect()}
    assert len(rows) == more.count()
    for r in rows:
        base = brute_base(texts[r.doc_id])
        base.sort(key=lambda s: (s[0], pii.BASE.index(s[2])))
        line = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, _, k in base) for kind in pii.BASE)
        assert set(line) <= set(r.spans.split(",")) | {""}
    assert any("name:" in r.spans for r in rows)
    assert pii.report(nothing, field).count() == 0
    assert pii.find(docs, field).columns == [*[c for c in docs.columns if c != "text"], "__spans"]
