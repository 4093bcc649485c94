"""Counts against the tokenizer library; prefix counts and cuts by re-encoding."""

import random

import pytest
from marquee.llm import token_counts as tc

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def encode():
    t = tokenizers.Tokenizer.from_file(tc.vocabulary_path())
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


PARTS = ["a", "b", "the", " ", "  ", "\n", "'re", "'", "1", "é", "ß", "漢", "<|endoftext|>", "<|", "!", "\t", "ing", "\xa0", "😀",
         "\x1c", " ", "Ⅷ", "²"]


def test_prefix_counts_and_cuts_equal_re_encoding(encode):
    rnd, c = random.Random(1), tc.counter(tc.vocabulary_path())
    for _ in range(400):
        s = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 20)))
        counts = [encode(s[:p]) for p in range(len(s) + 1)]
        t = tc.PrefixTable(c, s)
        assert c.count(s) == counts[-1], s
        assert [t.at(p) for p in range(len(s) + 1)] == counts, s
        for budget in (0, 1, 3, 8):
            assert t.cut(budget) == max(p for p, n in enumerate(counts) if n <= budget), (s, budget)


def test_code_points(encode):
    c = tc.counter(tc.vocabulary_path())
    for cp in [*range(0x250), *range(0x2000, 0x2070), 0xFEFF, 0xFFFD, 0x1F600, 0xE0001]:
        s = f"a{chr(cp)}b {chr(cp)}  {chr(cp)}{chr(cp)}x\n {chr(cp)}"
        assert c.count(s) == encode(s), hex(cp)


def test_query_rows(make_docs, hard_rows, encode):
    got = tc.count_tokens(make_docs(hard_rows, extra=True)).collect()
    assert len(got) == len(hard_rows)
    texts = sorted((str(i), t or "") for i, t in hard_rows)
    for (_, text), r in zip(texts, sorted(got, key=lambda r: (str(r.doc_id), r.n_bytes)), strict=True):
        assert r.n_bytes == len(text.encode()) and r.n_tokens == encode(text) and r.over_limit == (r.n_tokens > 1024)
        assert encode(text[:r.cut_chars]) <= 1024
    assert tc.count_tokens(make_docs([])).count() == 0


def test_stored_prefix_table_answers_budgets(make_docs, encode):
    text = "Some words, and then some more of them; 12 or 13."
    table = tc.prefix_table(make_docs([(1, text), (2, None)]))
    got = {r.doc_id: r for r in tc.within_budget(table, 5).collect()}
    assert got[1].n_tokens == encode(text) and encode(text[:got[1].piece_cut_chars]) == 5
    assert got[2].n_tokens == 0 and got[2].piece_cut_chars == 0


def test_long_runs_are_cut_without_counting_each_prefix(encode):
    rnd, c = random.Random(2), tc.PrefixCounter(tc.vocabulary_path())
    for letters in ("ACGT", "aé漢ß", " \n", "!?'", "12"):
        s = "x " + "".join(rnd.choice(letters) for _ in range(300)) + "<|endoftext|> y"
        counts = [encode(s[:p]) for p in range(len(s) + 1)]
        t = tc.PrefixTable(c, s)
        assert t.prefixes() == counts
        for budget in (1, 20, 60, counts[-1] - 1):
            assert t.cut(budget) == max(p for p, n in enumerate(counts) if n <= budget)
    before, counted, run = len(c.piece_counts), [], c.prefix_counts
    c.prefix_counts = lambda piece: counted.append(len(piece)) or run(piece)
    long = "".join(rnd.choice("ACGT") for _ in range(100_000))
    p = tc.PrefixTable(c, long).cut(1024)
    assert encode(long[:p]) <= 1024 < encode(long[:p + 1])
    assert sum(counted) < 10 * len(long) and len(c.piece_counts) <= before + 10


def test_stored_table_gives_the_exact_cut(make_docs, encode):
    text = "Some words, and incomprehensibilities ACGTTGCATTAGACAGT of them <|endoftext|>; 12 or 13."
    table = tc.prefix_table(make_docs([(1, text), (2, None)]))
    for budget in (0, 3, 8, 12, 15, 99):
        got = {r.doc_id: r for r in tc.within_budget(table, budget).collect()}
        assert got[1].cut_chars == max(p for p in range(len(text) + 1) if encode(text[:p]) <= budget) and got[2].cut_chars == 0
