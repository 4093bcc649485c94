"""Decontamination, licenses, revisits, quality, mixing and the pipeline."""

import math
import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from marquee.llm import decontamination as dec
from marquee.llm import licenses, mixing, quality, revisits
from marquee.llm import queries as llm_queries
from marquee.llm.lexer import PUNCTUATION

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SF = "/root/testdata/sf0.01"
QUESTION = "If Alice walks 12 km in 3 hours and then Alice rests, how far does Alice walk in 12 hours on that day?"
BENCH = "item_id bigint, text string"


def test_reparameterised_question(spark, make_docs):
    bench = spark.createDataFrame([(1, QUESTION), (2, "three words only"), (3, None), (4, QUESTION.replace("12", "99"))], BENCH)
    same = QUESTION.replace("Alice", "Bertram").replace("12", "40").replace("3 hours", "5 hours")
    mixed = QUESTION.replace("then Alice", "then Clara").replace("12 km", "7 km")
    rows = [(1, "Some text before. " + same + " And some after."), (2, mixed), (3, "Nothing of the kind is said in this text."),
            (4, None), (5, ""), (None, QUESTION), (6, QUESTION), (6, QUESTION)]
    docs = make_docs(rows, extra=True)
    got = {(r.doc_id, r.item_id): r for r in dec.report(docs, bench).collect()}
    assert set(got) == {(1, 1), (6, 1), (None, 1)} and got[1, 1].n_items == 2 and got[1, 1].n_changed_slots > 0
    kept = dec.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert dec.report(docs, bench.limit(0)).count() == 0 and dec.report(make_docs([]), bench).count() == 0


def test_items_of_one_template_short_items_and_items_without_id(spark, make_docs):
    apples = "After lunch she counted 3 apples and {} pears on the big table by the window"
    bench = spark.createDataFrame([(1, apples.format(3)), (2, apples.format(4)), (None, "Which rivers of the old country reach the sea?"),
                                   (None, "How many stars shine above the harbour tonight?"), (5, "Name the moons"),
                                   (6, "12 km 7 hours 90 miles 4 days")], BENCH)
    rows = [(1, apples.format(4)), (2, apples.format(3)), (3, apples.format(5).replace(" 3 ", " 8 ")),
            (4, "He asked: Which rivers of the old country reach the sea? Nobody knew."),
            (5, "How many stars shine above the harbour tonight?"), (6, "Please name the moons, he said."),
            (7, "It took 12 km 7 hours 90 miles 4 days in all."), (8, "It took 13 km 8 hours 91 miles 5 days in all.")]
    docs = make_docs(rows)
    got = sorted((r.doc_id, r.item_id or 0, r.n_items, r.n_changed_slots > 0) for r in dec.report(docs, bench).collect())
    # item 2's slots may stand for equal values, item 1's never for different ones
    assert got == [(1, 2, 1, False), (2, 1, 1, False), (2, 2, 1, True), (3, 2, 1, True), (4, 0, 1, False), (5, 0, 1, False),
                   (6, 5, 1, False), (7, 6, 1, False)]
    assert [r.doc_id for r in dec.clean(docs, bench).collect()] == [8]


def test_decontamination_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: [w for w in (x.strip(".,;:!?\"'()[]{}<>|*#%&$").lower() for x in t.split()) if w]
    items = {r.item_id: {tuple(w[i:i + 5]) for w in [words(r.text)] for i in range(len(w) - 4)} for r in bench.collect()}
    expected = set()
    for r in docs.collect():
        w = words(r.text)
        grams = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        expected |= {(r.doc_id, i) for i, g in items.items() if g and len(g & grams) >= 0.6 * len(g)}
    got = {(r.doc_id, r.item_id) for r in dec.report(docs, bench).collect()}
    assert expected and got == expected


def test_license_spans(make_docs, hard_rows):
    mit = licenses.TEMPLATES["mit-text"]
    edited = mit.replace("free of charge", "at no charge").replace("merge, publish,", "publish,")
    text = f"Foo bar. Released under the MIT License. Then {edited} End."
    got = licenses.scan(make_docs([(1, text), *hard_rows], extra=True)).collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "mit"), (1, "mit-text")]
    assert text[got[0].start:got[0].end] == "Released under the MIT License."
    assert got[0].coverage == 1 and 0.9 < got[1].coverage < 1 and text[got[1].start:got[1].end].startswith("Permission is")
    assert licenses.scan(make_docs([])).count() == 0


def test_license_scan_against_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    notices = {k: t for k, t in licenses.TEMPLATES.items() if len(t.split()) < 12 and k not in ("all-rights-reserved", "gpl-2.0")}
    expected = Counter((r.doc_id, k) for r in docs for k, t in notices.items() for _ in re.findall(re.escape(t), r.text))
    got = Counter((r.doc_id, r.license) for r in llm_queries.queries()["op1_license_scan"](spark, SF).collect())
    assert expected and {k: n for k, n in got.items() if k[1] in notices} == expected


def test_short_licenses_are_all_found(spark):
    plain = lambda t: [w for w in (x.strip(PUNCTUATION).lower() for x in t.split()) if w]
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    notices = {k: plain(licenses.TEMPLATES[k]) for k in ("all-rights-reserved", "gpl", "gpl-2.0", "mit", "cc-by-4.0")}
    expected = Counter((d, k) for d, w in docs.items() for k, n in notices.items()
                       for i in range(len(w)) if w[i:i + len(n)] == n)
    got = Counter((r.doc_id, r.license) for r in llm_queries.queries()["op1_license_scan"](spark, SF).collect() if r.coverage == 1)
    assert {k for _, k in expected} >= {"all-rights-reserved", "gpl"} and {k: n for k, n in got.items() if k[1] in notices} == expected


def test_short_licenses_in_any_neighbourhood():
    index = licenses.Index(licenses.TEMPLATES)
    for i in range(200):
        assert [m["license"] for m in index.scan(f"word{i} All rights reserved. other{i}")] == ["all-rights-reserved"]
        assert [m["license"] for m in index.scan(f"word{i} Released under this MIT License other{i}")] == ["mit"]
        assert [m["license"] for m in index.scan(f"word{i} Released by the MIT License other{i}")] == ["mit"]
    assert len(index.scan("All rights reserved. All rights reserved. All rights reserved.")) == 3
    assert licenses.Index({"a": "", "b": "Copyleft"}).scan("x copyleft")


def test_revisits_oracle(spark):
    from harness import compare, duck
    name = "op3_warc_revisits"
    ok, why = compare(llm_queries.queries()[name](spark, SF), duck(SF), llm_queries.oracle_sql()[name])
    assert ok, why


def test_revisits_cases(spark):
    kind = "record_id bigint, ts bigint, url string, kind string, etag string, last_modified string, headers map<string,string>"
    rows = [(1, 10, "http://www.A.com/x/?b=2&a=1&utm_source=q", "response", "e1", "m1", {"etag": "e1", "content-length": "5", "date": "d1"}),
            (2, 20, "https://a.com:443/x?a=1&b=2", "response", "e2", "m2", {"content-length": "6"}),
            (3, 20, "a.com/x?a=1&b=2#f", "revisit", "e1", None, {"date": "d3", "content-length": "0", "set-cookie": "s"}),
            (4, 21, "a.com/x?a=1&b=2", "revisit", "e1", None, None), (5, 5, "a.com/x?a=1&b=2", "revisit", "e1", None, {}),
            (6, 30, "a.com/x?a=1&b=2", "revisit", None, "m2", {}), (7, 30, "a.com/x?a=1&b=2", "revisit", None, None, {}),
            (8, None, "a.com/x", "revisit", "e", None, {}), (9, 9, None, "revisit", "e", None, {}), (9, 9, None, "revisit", "e", None, {}),
            (None, 1, "a.com/x", "response", "e", "m", {})]
    for buckets in (1, 3, 64):
        got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, kind), buckets).collect()}
        assert {k: (r.status, r.response_id) for k, r in got.items()} == {
            3: ("resolved", 1), 4: ("validator_mismatch", 2), 5: ("no_response", None), 6: ("resolved", 2),
            7: ("validator_mismatch", 2), 8: ("invalid", None), 9: ("invalid", None)}
        assert [tuple(h) for h in got[3].headers] == [("content-length", "5"), ("date", "d3"), ("etag", "e1")]
    assert revisits.resolve(spark.createDataFrame([], kind)).count() == 0


def slow_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(w), sum(map(len, w)), n_symbols, len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality_counts(spark, make_docs, hard_rows):
    rows = [*hard_rows, (20, "a b a b a b a b"), (21, "x\n x\nx\n\n \ny\nx"), (22, "   q \x1c"), (23, "a b c d a b c")]
    got = quality.judged(make_docs([(*r, None if i % 3 else "l", None if i % 2 else "s") for i, r in enumerate(rows)], extra=True)).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, ((i, *slow_measures(t)) for i, t in rows)))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = quality.judged(docs).collect()
    assert all(tuple(r)[1:7] == slow_measures(texts[r.doc_id]) for r in judged)
    good = [r.kept for r in judged if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in judged if labels.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1
    assert quality.judged(make_docs([])).count() == 0


def test_quality_verdicts_by_brute_force(spark):
    """Exact quantiles in place of sketches give the same verdicts, and cutoffs differ between groups."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in quality.measured(docs).collect()]
    groups = {}
    for r in (r for r in rows if not r["base_failed"]):
        for key in ((r["lang"], r["source"]), (r["lang"],), ()):
            groups.setdefault(key, []).append(r)

    def quantile(key, rule, level):
        values = sorted(r[rule] for r in groups[key])
        own = values[max(0, math.ceil(round(level * len(values), 9)) - 1)]
        if not key:
            return own
        weight = len(values) / (len(values) + quality.PRIOR_ROWS)
        return weight * own + (1 - weight) * quantile(key[:-1], rule, level)

    limits = {}
    for key in (k for k in groups if len(k) == 2):
        for rule, (level, width, grain, both) in quality.RULES.items():
            low, mid, high = (quantile(key, rule, x) for x in (round(1 - level, 4), 0.5, level))
            limits[key, rule] = (round(low - width * (mid - low) - grain, 3) if both else -math.inf,
                                 round(high + width * (high - mid) + grain, 3))
    for rule in ("capitals", "dup_lines", "word_length"):
        assert len({v for (_, x), v in limits.items() if x == rule}) > 5
    wanted = {r["doc_id"]: not r["base_failed"] and all(
        limits[(r["lang"], r["source"]), x][0] <= r[x] <= limits[(r["lang"], r["source"]), x][1] for x in quality.RULES) for r in rows}
    assert {r.doc_id: r.kept for r in quality.judged(docs, sketch_k=4000).collect()} == wanted


def test_mixing_reaches_targets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    classifier = mixing.learn(docs, mixing.label_domains(labels))
    scored = mixing.scores(docs, classifier, ["doc_id"])
    plan = mixing.fit(classifier, scored, mixing.TARGETS)
    rows = scored.select("n", "q", plan.rate(scored["p"]).alias("r")).collect()
    total = sum(r.n for r in rows)
    for i, d in enumerate(classifier.domains):  # unrounded posteriors
        assert abs(sum(r.n * r.r * r.q[i] for r in rows) / total - mixing.TARGETS[d]) < 1.01 * mixing.TOLERANCE
    assert all(r.r >= 0 and abs(sum(r.q) - 1) < 1e-9 for r in rows)
    with pytest.warns(UserWarning, match="off its targets"):
        missed = mixing.fit(classifier, scored, {"plain": 0.2, "low": 0.5, "toxic": 0.3}, iterations=1)
    assert missed.off_target > mixing.TOLERANCE and len(missed.steps) == 1


def test_mixing_hard_rows(spark, make_docs, hard_rows):
    docs = make_docs(hard_rows, extra=True)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (4, 1, 1), (None, 1, 0), (8, None, None)], "doc_id bigint, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        assert mixing.report(make_docs(hard_rows, extra=True), table).count() == len(hard_rows)
        out = mixing.mixed(docs, table)
        assert out.columns == [*docs.columns, "rate_", "copies_"]
        assert all(r["copies_"] > 0 and r["rate_"] >= 0 for r in out.collect())
    assert mixing.report(make_docs([]), labels).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [{r.doc_id for r in docs.collect()}]
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append({r.doc_id for r in docs.collect()})
        assert docs.count() == len(ids[-1])
    assert ids[0] >= ids[1] > ids[2] >= ids[3] == ids[4]
    assert {r.doc_id for r in cp.run(spark, sf).collect()} <= ids[4]


def test_a_text_is_read_once_for_windows_of_every_kind(monkeypatch):
    from marquee.llm import lexer as lx
    text, reads, read = "The 12 old boats of Captain Alba left at dawn, 3 km off the Northern coast.", [], lx.Lexer.read
    monkeypatch.setattr(lx.Lexer, "read", lambda self, t: reads.append(t) or read(self, t))
    lexer = lx.Lexer()
    raw, slots, at, h = dec.text_windows(lexer, text, 3, True)
    assert len(reads) == 1 and at.tolist() == list(range(len(raw) - 2)) and len(set(h.tolist())) == len(at)
    usual = dec.text_windows(lexer, text, 3, False)
    marks = slots.tolist()
    assert usual[2].tolist() == [i for i in range(len(raw) - 2) if sum(marks[i:i + 3]) <= 1]


def test_word_kinds_are_those_of_their_characters():
    from marquee.llm import lexer as lx
    lexer = lx.Lexer()
    for w in ("word", "12", "1,234.5", "km", "KM.", "a1", "x²", "٣", "½", "Ünïcode", "it's", "--", "数", "3rd"):
        lexer.read(w)
        bare = w.strip(PUNCTUATION)
        number = any(c.isdigit() for c in bare) and not any(c.isalpha() for c in bare)
        expected = lx.NUMBER if number else lx.UNIT if bare.lower() in lx.UNITS else lx.WORD
        assert lexer.kinds[lexer.number[w]] == expected
