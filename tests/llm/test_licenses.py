"""License scans against full alignment: notices with word groups inserted, dropped and changed."""

import math
import random

import numpy as np
import pytest

from marquee.llm import licenses

OFFSET = 12


def edited(words, draw):
    words, made = list(words), 0
    for _ in range(draw.randrange(1, 4)):
        at, n = draw.randrange(len(words) + 1), draw.randrange(1, 4)
        kind = draw.choice(("insert", "drop", "change"))
        fresh = [f"foreign{draw.randrange(10**6)}" for _ in range(n)]
        words[at:at + (0 if kind == "insert" else n)] = [] if kind == "drop" else fresh
        made += 1
    return words


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_no_accepted_alignment_is_overlooked(name):
    draw = random.Random(name)
    index = licenses.Index({name: licenses.TEMPLATES[name]})
    template, needed = index.words[0], licenses.LEAST_COVERAGE * len(index.words[0])
    accepted = 0
    for _ in range(40 if len(template) < 30 else 12):
        words = [f"before{draw.randrange(9)}" for _ in range(OFFSET)] + edited(licenses.TEMPLATES[name].split(), draw) + ["after"] * 12
        text = " ".join(words)
        hashes = index.lexer.read(text)[1]
        best = max((licenses.align(template, hashes, s, licenses.BAND) or (0,))[0] for s in range(OFFSET - 9, OFFSET + 10))
        if best >= needed:
            accepted += 1
            assert index.scan(text), text
    assert accepted or len(template) < 8


def test_sure_runs_hold_a_fingerprint():
    """Any run of that many template words holds one of its fingerprints; longer templates are winnowed."""
    lexer, winnowed = licenses.Lexer(), 0
    for text in licenses.TEMPLATES.values():
        raw, words, *_ = lexer.read(text)
        k, prints = licenses.fingerprints(words, [len(r) for r in raw], licenses.LEAST_COVERAGE)
        run = licenses.sure_run(len(words), licenses.LEAST_COVERAGE)
        places = {p for ps in prints.values() for p in ps}
        if run == 1:
            assert len(places) > len(words) - math.ceil(licenses.LEAST_COVERAGE * len(words))
            continue
        assert all(any(p in places for p in range(i, i + run - k + 1)) for i in range(len(words) - run + 1))
        winnowed += len(places) < len(words) - k + 1
    assert winnowed >= 2


def test_notices_in_a_row_and_words_between():
    index = licenses.Index(licenses.TEMPLATES)
    mit, isc = (licenses.TEMPLATES[k] for k in ("mit-text", "isc-text"))
    spread = " ".join(w if i % 23 else f"{w} odd{i}" for i, w in enumerate(isc.split(), 1))
    got = [m["license"] for m in index.scan(f"{mit} {mit} {spread} All old rights reserved.")]
    assert got == ["mit-text", "mit-text", "isc-text", "all-rights-reserved"]
    assert index.scan(None) == index.scan("") == index.scan("license " * 50_000) == []
    assert isinstance(index.words[0], np.ndarray)
