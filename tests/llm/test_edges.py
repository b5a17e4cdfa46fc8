"""Clashing columns, repeated rows and missing ids, and recall of fuzzy passages."""

import random
from collections import Counter

import numpy as np
import pytest

from shelfsight.llm import decontamination, infill, licenses, line_dedup, ngram_join, passages, quality, secrets, store, subwords
from shelfsight.llm.queries import MODEL
from shelfsight.llm.words import WordHashes, windows

RNG = random.Random(21)
TEXTS = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "", None, "token = abcdef12\nline two"]
#: Names that the operators give to what they add, and one of their helpers' names.
CLASHES = "n_words string, N_Lines string, n_removed int, licenses string, hits string, ids string, decoded string, " \
          "spans string, kept string, base_failed int, output int, form string, known_blob int, own_blob string, " \
          "group_lang string, __spans int"


def docs(spark, texts=TEXTS):
    n = CLASHES.count(",") + 1
    types = [c.split()[1] for c in CLASHES.split(", ")]
    rows = [(i, t, "en", "s1", *("old" if k == "string" else 7 for k in types[:n])) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + CLASHES)


def test_new_columns_replace_clashing_ones(spark):
    rows = docs(spark)
    bench = spark.createDataFrame([("b", TEXTS[0])], "item_id string, text string")
    shipped = subwords.ship(spark, MODEL)
    cases = {
        quality.scored(rows): ["n_words", "kept", "base_failed"], line_dedup.without_boilerplate(rows): ["n_lines", "n_removed"],
        licenses.scan(rows): ["licenses"], decontamination.scan(rows, bench): ["n_words", "hits"],
        subwords.decode(subwords.encode(rows, shipped), shipped): ["ids", "decoded"],
        secrets.scan_versions(rows): ["spans"], infill.transform(rows): ["output", "form", "n"]}
    for out, new in cases.items():
        names = [c.lower() for c in out.columns]
        assert len(names) == len(set(names)) and set(new) <= set(out.columns)
        left = [c for c in rows.columns if c.lower() not in new and c.lower() in names and c not in ("text",)]
        got = {r["doc_id"]: r for r in out.collect()}
        assert len(got) == len(TEXTS)
        for r in rows.collect():
            for c in left:
                if c.lower() not in {x.lower() for x in ("n_words", "n_lines")}:
                    assert got[r["doc_id"]][c] == r[c], (c, new)
        assert all(got[0][c] not in ("old",) for c in new)
    with pytest.raises(ValueError):
        decontamination.scan(rows, bench, words="text")


def test_rows_that_repeat_a_kept_document_are_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None), (3, None), (4, "other words"), (5, "x"), (5, "y")],
                                 "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["text"] or "") for r in ngram_join.representatives(rows).collect())
    assert got == [(1, text), (3, ""), (3, ""), (4, "other words"), (5, "x"), (5, "y")]


def test_items_without_an_id_hit_but_are_not_counted(spark):
    rows = docs(spark).select("doc_id", "text")
    bench = spark.createDataFrame([(None, TEXTS[0]), ("b", "alpha beta gamma delta epsilon zeta eta theta iota kappa")],
                                  "item_id string, text string")
    got = {r["doc_id"]: r for r in decontamination.report(rows, bench).collect()}
    assert (got[0]["n_hit"], got[0]["n_items"], got[0]["contaminated"]) == (12, 1, True)
    only = {r["doc_id"]: r for r in decontamination.report(rows, bench.where("item_id is null")).collect()}
    assert (only[0]["n_hit"], only[0]["n_items"], only[0]["contaminated"]) == (12, 0, True)
    assert [only[i]["n_hit"] for i in (1, 2, 3)] == [0, 0, 0]


def test_a_ledger_that_holds_a_blob_twice(spark, tmp_path):
    """As two runs at once leave it: no row of the result is doubled."""
    rows, path = docs(spark).select("doc_id", "text"), str(tmp_path / "ledger")
    secrets.scan_versions(rows, path).count()
    book = spark.read.parquet(path)
    store.written(book, "ledger-copy").write.mode("append").parquet(path)
    assert secrets.scan_versions(rows, path).count() == len(TEXTS)


def test_common_lookup_equals_each_template_by_itself():
    cache = WordHashes()
    words = ["w%d" % i for i in range(12)]
    known = [licenses.Template("t%d" % k, [RNG.choice(words) for _ in range(RNG.randrange(2, 9))], cache) for k in range(9)]
    both = licenses.Templates(known, 0.8)
    for _ in range(300):
        grams = windows(cache.of([RNG.choice(words).encode() for _ in range(RNG.randrange(2, 40))]), 2)
        want = Counter({t.name: repr(w) for t in known if (w := licenses.best_windows(grams, t, 0.8))})
        got = {t.name: repr(w) for t, p in both.near(grams) if (w := licenses.best_windows(grams, t, 0.8, p))}
        assert got == dict(want)


def test_templates_from_a_table(spark):
    full = " ".join(f"clause{i % 40} word{i}" for i in range(400))
    table = spark.createDataFrame([("Own-1.0", full), ("Own-1.0", "own notice of this licence"), (None, "x y"), ("Empty", None),
                                   ("Short", "one")], "license string, text string")
    chosen = licenses.template_table(table)
    assert {k: len(v) for k, v in chosen.items()} == {"Own-1.0": 2}
    part = " ".join(full.split()[:700])
    got = licenses.scan(docs(spark, ["before " + part + " after", "nothing"]), templates=chosen).collect()
    found = {r["doc_id"]: [(m["license"], round(m["dice"], 2)) for m in r["licenses"]] for r in got}
    assert found[1] == [] and found[0][0][0] == "Own-1.0" and found[0][0][1] > 0.9


@pytest.mark.parametrize("words,edits,least", [(60, 0.0, 1.0), (60, 0.05, 0.85), (100, 0.1, 0.85), (200, 0.15, 0.85)])
def test_recall_of_fuzzy_passages(spark, words, edits, least):
    """Planted passages with substituted words: found if the pair has a passage within the planted one."""
    rng = np.random.default_rng(words)
    vocabulary = np.array(["v%d" % i for i in range(4000)])
    rows, pairs = [], 40
    for k in range(pairs):
        passage = rng.choice(vocabulary, words)
        copy = np.where(rng.random(words) < edits, rng.choice(vocabulary, words), passage)
        for i, p in enumerate((passage, copy)):
            rows.append((2 * k + i, " ".join([*rng.choice(vocabulary, 80), *p, *rng.choice(vocabulary, 80)])))
    got = passages.shared(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = {r["doc_id"] for r in got if r["other_id"] == r["doc_id"] - 1 and r["start"] >= 70 and r["stop"] <= 90 + words}
    assert len(found) >= least * pairs


def test_frequency_maps_are_the_same_in_pieces(spark, monkeypatch):
    """A range that is counted slot by slot, because it is long, gives the maps of one that is sorted at once."""
    text = [" ".join(RNG.choice(["a", "b", "c", "d"]) for _ in range(RNG.randrange(5, 60))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string")
    packed = store.written(ngram_join.measured(rows, "text", "doc_id").where("kind = 1").select("id", "packed"), "packed")

    def maps():
        return sorted((r["range"], r["step"], r["bits"], bytes(r["slice"])) for r in ngram_join.frequency_maps(packed).collect())

    once = maps()
    monkeypatch.setattr(ngram_join, "RANGE_VALUES", 1)
    assert maps() == once and max(step for _, step, _, _ in once) >= 4
