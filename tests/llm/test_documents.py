"""Document operators against brute force, with nulls, empty and repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from shelfsight.llm import (components, decontamination, licenses, line_dedup, ngram_join, passages, quality, secrets,
                            subwords)
from shelfsight.llm.queries import MODEL

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, hits int"
RNG = random.Random(7)
VOCABULARY = ["w%d" % i for i in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(text, edits):
    words = text.split()
    for _ in range(edits):
        words[RNG.randrange(len(words))] = "edit%d" % RNG.randrange(99)
    return " ".join(words)


def table(spark, texts):
    rows = [(i, t, "en", "s%d" % ((i or 0) % 7), None, "clash", 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    base = [prose(RNG.randrange(60, 200)) for _ in range(25)]
    texts = [*base, *(edited(RNG.choice(base), RNG.randrange(0, 4)) for _ in range(60)), None, "", " \t\n", "one two",
             "ONE two", "a b c d e", prose(6000), *(base[0] for _ in range(30)), *(edited(base[1], 2) for _ in range(40))]
    out = list(enumerate(texts))
    return out + [out[3], out[30], (None, base[5]), (None, None)]


def components_by_brute_force(texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(texts)), key=str)


@pytest.mark.parametrize("part", [ngram_join.PART_SHINGLES, 300])
def test_join_equals_brute_force(spark, corpus, part):
    got = ngram_join.grouped(table(spark, corpus), part_shingles=part, part_prefix=max(part // 3, 50))
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()]
    assert sorted(rows, key=str) == components_by_brute_force(corpus)


def test_join_keeps_one_of_each_group(spark, corpus):
    docs = table(spark, corpus)
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    roots = {c for i, n, c in components_by_brute_force(corpus) if i is not None}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == roots
    assert ngram_join.grouped(docs.limit(0)).count() == 0


def test_packed_values_come_back():
    for values in ([5], [5, 5, 70], [0, 1 << 20, (1 << 20) + 1], [7, 4_000_000_000]):
        x = np.array(values, np.uint32)
        assert (ngram_join.unpack(ngram_join.pack(x)) == x).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2)]
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "test")
    roots = {r["node"]: r["root"] for r in got.collect()}
    assert roots == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}


def quality_by_brute_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def test_quality_counts_and_verdicts(spark):
    junk = " ".join(w + "###" for w in prose(80).split())
    texts = [None, "", "a b c", prose(60), "é à ü " * 20, "x\nx\n\n x\ny", junk, prose(300) + "\n# one mark", "A b c",
             "a a a a a a", prose(5000)] + [prose(70 + k) for k in range(40)]
    docs = table(spark, list(enumerate(texts)))
    rows = {r["doc_id"]: r for r in quality.scored(docs.drop("n_words"), group_rows=5).collect()}
    for i, t in enumerate(texts):
        r, (n, chars, symbols, lines, repeats) = rows[i], quality_by_brute_force(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == \
            (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert r["kept"] == (not r["base_failed"] and i != 6)
    kept = quality.kept_only(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows.values())
    assert quality.scored(docs.drop("n_words").limit(0)).count() == 0


def lines_by_brute_force(texts, sites, least):
    strip = " \t\n\r\v\f"
    spread, keeper = {}, {}
    for (i, t), s in zip(texts, sites):
        for x in (t or "").split("\n"):
            x = x.strip(strip)
            if x:
                spread.setdefault(x, set()).add(s)
                keeper[x] = min(keeper.get(x, i), i)
    out = {}
    for i, t in texts:
        seen, kept = set(), []
        for x in (t or "").split("\n"):
            y = x.strip(strip)
            if not (y and len(spread[y]) >= least and (keeper[y] != i or y in seen)):
                kept.append(x)
            seen.add(y)
        out[i] = None if t is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("small", [line_dedup.SMALL_ROWS, 0])
def test_line_dedup_equals_brute_force(spark, small):
    pool = ["Subscribe now", "  share this", "Über uns", "footer", "x"]
    texts = [(i, "\n".join(RNG.choice([*pool, "", "own %d" % i, "own %d" % i]) for _ in range(6))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "\n\n"), (63, "footer\nfooter\n")]
    docs = table(spark, texts)
    got = line_dedup.without_boilerplate(docs, small_rows=small, removed="gone", total="lines")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == \
        lines_by_brute_force(texts, ["s%d" % (i % 7) for i, _ in texts], line_dedup.MIN_SITES)
    assert line_dedup.deduped(docs).columns == docs.columns
    assert line_dedup.deduped(docs.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark):
    words = prose(40).split()
    bench = [(1, " ".join(words[:25])), (12, "Short ITEM, here"), (3, None), (4, "..."), (None, "a b"),
             (1, " ".join(words[:25])), (2, " ".join(words[10:40]))]
    texts = [None, "", " ".join(words[:10]), "x " + " ".join(words[3:30]) + " y", "a short item here", "short-item!HERE",
             "ß short item here é", " ".join(words[:9]), prose(3000)]
    docs = table(spark, list(enumerate(texts)))
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    rows = {r["doc_id"]: r for r in decontamination.report(docs, benchmark).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(t):
        return word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    for i, t in enumerate(texts):
        own, hit, items = split(t), set(), set()
        for item, body in bench:
            w = split(body)
            n = min(10, len(w))
            for k in range(len(w) - n + 1 if item is not None and n else 0):
                for p in range(len(own) - n + 1):
                    if own[p:p + n] == w[k:k + n]:
                        hit |= set(range(p, p + n))
                        items.add(str(item))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == \
            (len(own), len(hit), len(items), digest, bool(hit))
    found = decontamination.scan(docs.drop("hits", "n_words"), benchmark, item_bytes=100)  # several automata
    spans = {r["doc_id"]: r["spans"] for r in decontamination.original_spans(found).collect()}
    assert texts[5][spans[5][0]["start"]:spans[5][0]["stop"]] == "short-item!HERE"
    assert {i for i, s in spans.items() if s} == {i for i, r in rows.items() if r["contaminated"]}
    clean = decontamination.clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, r in rows.items() if not r["contaminated"]}
    assert decontamination.report(docs.limit(0), benchmark.limit(0)).count() == 0


def test_subwords_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [None, "", " ", "a   b", "héllo wörld\n\tx", "日本語 🙂 ﬁ", "▁▁x", "<s> <0x0A>", "abc" * 200, "=" * 90, prose(2000)]
    texts += ["".join(RNG.choice("aber the\n ▁.,!12éß中🙂") for _ in range(RNG.randrange(90))) for _ in range(200)]
    docs = table(spark, list(enumerate(texts)))
    for r in subwords.round_trip(docs, MODEL).collect():
        assert r["ids"] == model.encode(texts[r["doc_id"]] or "") and r["decoded_equal"]
    assert subwords.round_trip(docs.limit(0), MODEL).count() == 0


def test_secrets_equal_brute_force_and_the_ledger_grows(spark, tmp_path):
    texts = [None, "", "password = 'abcdef1' token: x", "é token=token:abcdef AKIA" + "A1" * 9, "AKIA123 " + "0a" * 20,
             "api_key\"='" + "f" * 30 + "' secret:ab", "-----BEGIN RSA PRIVATE KEY-----", "PASSWD:  \"x.y_z-1\"", prose(3000)]
    texts += [texts[3]]
    docs = table(spark, list(enumerate(texts)))
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secrets.report(docs).collect():
        t = texts[r["doc_id"]] or ""
        want = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(want))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert r["n_assign"] == sum(w[2] == "assign" for w in want)
    path = str(tmp_path / "ledger")
    first = secrets.scan_versions(docs.where("doc_id < 4"), path)
    assert first.columns == [*docs.columns, "spans"] and first.count() == 4
    assert spark.read.parquet(path).count() == 3  # null and empty text are one blob
    assert secrets.scan_versions(docs, path).where("spans is not null").count() == len(texts)
    assert spark.read.parquet(path).count() == len({t or "" for t in texts})
    assert secrets.report(docs.limit(0)).count() == 0


def test_licenses(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [None, "", "word", notice, prose(50) + "\n" + notice + "\n" + prose(50), "released UNDER the mit license",
             "licensed under the apache licence version 2.0", prose(3000), "İ " + notice]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(table(spark, list(enumerate(texts)))).collect()}
    assert {i for i, m in got.items() if m} == {3, 4, 5, 8}
    span = got[4][0]
    assert texts[4][span["start"]:span["stop"]] == notice[:-1] and span["license"] == "Apache-2.0" and span["dice"] == 1.0
    assert texts[8][got[8][0]["start"]:got[8][0]["stop"]] == notice[:-1]
    assert [m["license"] for m in got[5]] == ["MIT"]
    assert licenses.scan(table(spark, [(0, "x")]).limit(0)).count() == 0


def test_shared_passages_are_found(spark):
    passage = prose(70)
    texts = [prose(100) + " " + passage + " " + prose(30), passage + " " + prose(60), prose(150), None, "", "few words",
             prose(20) + " " + edited(passage, 3) + " " + prose(90), prose(40) + " " + " ".join(passage.split()[:30])]
    texts += [texts[2]]
    docs = table(spark, [*enumerate(texts), (1, texts[1]), (None, passage)])
    got = {(r["doc_id"], r["other_id"]): r for r in passages.shared(docs).collect()}
    assert set(got) == {(1, 0), (6, 0), (8, 2)}
    r = got[(1, 0)]
    assert (r["start"], r["stop"], r["other_start"], r["other_stop"], r["likeness"]) == (0, 70, 100, 170, 1.0)
    assert got[(6, 0)]["likeness"] >= 0.9 and got[(8, 2)]["stop"] == 150
    assert passages.shared(docs.limit(0)).count() == 0


def test_chains_rise_on_both_sides():
    for _ in range(30):
        n = RNG.randrange(1, 30)
        x = np.array([RNG.randrange(60) for _ in range(n)])
        y = np.array([RNG.randrange(60) for _ in range(n)])
        found = passages.chains(x, y)
        assert sorted(k for c in found for k in c) == list(range(n))
        for c in found:
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:]))


def test_quality_fences_differ_between_groups(spark):
    def marked(words, n):
        return " ".join(w + "###" * (k < n) for k, w in enumerate(words.split()))

    def quoting(n):
        words = prose(200).split()
        for k in range(n):
            words[100 + 4 * k:103 + 4 * k] = words[4 * k:4 * k + 3]
        return " ".join(words)

    def shouted(n):
        return " ".join(w.upper() if k < n else w for k, w in enumerate(prose(200).split()))

    rows = [("plain", prose(200)) for _ in range(300)] + [("spam", prose(200)) for _ in range(60)]
    rows += [("spam", marked(prose(200), 100)) for _ in range(40)]  # over a quarter of its source, a tenth of all
    rows += [("headings", shouted(RNG.randrange(0, 41))) for _ in range(100)]
    rows += [("plain", shouted(90)), ("headings", shouted(90)), ("plain", marked(prose(200), 15))]
    rows += [("plain", quoting(20)), ("plain", quoting(1))]
    docs = spark.createDataFrame([(i, t, "en", s, None, "clash", 1) for i, (s, t) in enumerate(rows)], SCHEMA)
    kept = {r["doc_id"] for r in quality.scored(docs.drop("n_words"), group_rows=20).where("kept").collect()}
    assert kept == {i for i in range(len(rows)) if not 360 <= i < 400} - {500, 502, 503}


def test_license_windows_equal_brute_force():
    cache = licenses.WordHashes()
    for k in range(300):
        words = [RNG.choice("abcdef") for _ in range(RNG.randrange(2, 25))]
        template = licenses.Template("x", words, cache)
        cut = RNG.randrange(len(words))
        text = [RNG.choice("abcdefgh") for _ in range(4)] + words[cut // 3:] + [RNG.choice("abgh") for _ in range(4)]
        grams = licenses.windows(cache.of([w.encode() for w in text]), 2)
        best = 0.0
        for i in range(len(grams)):
            for j in range(i + 1, len(grams) + 1):
                shared = sum((licenses.Counter(grams[i:j].tolist()) & template.grams).values())
                best = max(best, 2 * shared / (j - i + template.size - 1))
        got = licenses.best_windows(grams, template, 0.8)
        assert max((d for d, _, _ in got), default=0.0) == (best if best >= 0.8 else 0.0)


def test_shortened_notices_match(spark):
    notice = licenses.TEMPLATES["BSD-3-Clause"][0].split()
    short = " ".join(notice[:int(0.75 * len(notice))])
    texts = [short, prose(40) + " " + short + " " + prose(40), " ".join(notice[:len(notice) // 2])]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(table(spark, list(enumerate(texts)))).collect()}
    assert [[m["license"] for m in got[i]] for i in range(3)] == [["BSD-3-Clause"], ["BSD-3-Clause"], []]
    assert texts[1][got[1][0]["start"]:got[1][0]["stop"]] == short


def test_partial_quotes_in_earlier_documents_hide_no_passage(spark):
    passage = prose(60).split()
    texts = [prose(40) + " " + " ".join(passage[max(0, 20 * k - 10):20 * k + 30]) + " " + prose(40) for k in range(3)]
    texts += [prose(30) + " " + " ".join(passage) + " " + prose(30) for _ in range(2)]
    again = prose(80)  # its middle stands earlier in the other document
    texts += [" ".join(again.split()[20:50]) + " " + prose(60) + " " + again, prose(25) + " " + again]
    docs = table(spark, list(enumerate(texts)))
    got = {(r["doc_id"], r["other_id"]): r for r in passages.shared(docs).collect()}
    assert set(got) == {(4, 3), (6, 5)}
    r = got[(4, 3)]
    assert all(abs(x - y) <= 3 for x, y in zip((r["start"], r["stop"], r["other_start"], r["other_stop"]), (30, 90, 30, 90)))
    r = got[(6, 5)]  # a word beside a passage may agree by chance
    assert all(abs(x - y) <= 3 for x, y in zip((r["start"], r["stop"], r["other_start"], r["other_stop"]), (25, 105, 90, 170)))


def test_passages_around_a_differing_stretch_are_found(spark):
    one, two, three = prose(100), prose(60), prose(100)
    texts = [one + " " + two, prose(20) + " " + one + " " + prose(60) + " " + two,
             one + " " + prose(100) + " " + three, one + " " + prose(100) + " " + three + " " + prose(9)]
    pairs = [(0, 1), (2, 3)]
    for k, pair in enumerate(pairs):
        docs = table(spark, [(i, texts[i]) for i in pair])
        got = sorted((r["start"], r["stop"], r["other_start"], r["other_stop"]) for r in passages.shared(docs).collect())
        wanted = [[(20, 120, 0, 100), (180, 240, 100, 160)], [(0, 100, 0, 100), (200, 300, 200, 300)]][k]
        assert len(got) == 2
        for g, w in zip(got, wanted):
            assert all(abs(x - y) <= 3 for x, y in zip(g, w))


def test_links_go_to_the_first_and_the_previous_holder(spark):
    rows = sorted({(RNG.randrange(4) if k % 2 else 0, RNG.randrange(60), RNG.randrange(30)) for k in range(400)})
    nth, seen = [], {}
    for s, d, _ in rows:
        nth.append(seen.get((s, d), 0))
        seen[s, d] = nth[-1] + 1
    found = spark.createDataFrame([(*r, n) for r, n in zip(rows, nth)], "seed bigint, doc bigint, place int, nth int")
    wanted = set()
    for s, d, x in rows:
        others = sorted({e for t, e, _ in rows if t == s and e < d})
        for e in {others[0], others[-1]} if others else ():
            places = sorted(y for t, f, y in rows if t == s and f == e)[:passages.PLACES]
            wanted |= {(d, e, x, y) for y in places}
    got = [tuple(r) for r in passages.matches(found.repartition(4)).collect()]
    assert set(got) == wanted


def test_parts_quoted_between_two_holders_hide_no_passage(spark):
    passage = prose(60).split()
    quotes = [" ".join(passage[k:k + 30]) for k in (0, 15, 30)]

    def around(middle):
        return prose(40) + " " + middle + " " + prose(40)

    texts = [*map(around, quotes), around(" ".join(passage)), *map(around, quotes), around(" ".join(passage))]
    # every part stands five times in the other document before the passage does
    second = prose(60).split()
    parts = " ".join(prose(20) + " " + " ".join(second[k:k + 30]) for _ in range(5) for k in (0, 15, 30))
    texts += [parts + " " + around(" ".join(second)), around(" ".join(second))]
    rows = passages.shared(table(spark, list(enumerate(texts)))).collect()
    got = {(r["doc_id"], r["other_id"]): (r["start"], r["stop"]) for r in rows}
    assert set(got) == {(7, 3), (9, 8)}
    assert all(abs(a - 40) <= 3 and abs(b - 100) <= 3 for a, b in got.values())


def test_stretches_that_repeat_themselves_are_covered(spark):
    line, word = prose(20), "same"
    texts = [" ".join([line] * 15), prose(30) + " " + " ".join([line] * 90) + " " + prose(30), " ".join([word] * 130),
             prose(20) + " " + " ".join([word] * 1000), prose(10) + " " + line + " " + line + " " + line + " " + prose(10)]
    covered, rows = {}, passages.shared(table(spark, list(enumerate(texts)))).collect()
    for r in rows:
        assert r["likeness"] >= 0.8
        covered.setdefault((r["doc_id"], r["other_id"]), set()).update(range(r["start"], r["stop"]))
    assert set(covered) == {(1, 0), (3, 2), (4, 0)}
    assert covered[1, 0] >= set(range(30, 1830)) and covered[3, 2] >= set(range(20, 1020)) and covered[4, 0] >= set(range(10, 70))
    assert len(rows) < 150  # not each round with each


def test_only_the_ends_of_repeats_are_kept():
    for _ in range(200):
        words = [RNG.choice("ab") for _ in range(RNG.randrange(1, 4))] * RNG.randrange(1, 30)
        words = [RNG.choice("abc") for _ in range(12)] + words + [RNG.choice("abc") for _ in range(RNG.randrange(30))]
        h = passages.WordHashes().of([w.encode() for w in words])
        at, s = passages.seeds_of(h)
        kept, run = passages.repeats(h, at, s)
        for name in np.unique(s):
            x = at[s == name].tolist()
            between = [x[i - 1] + x[i + 1] == 2 * x[i] and words[x[i - 1]:x[i] + passages.K] == words[x[i]:x[i + 1] + passages.K]
                       for i in range(1, len(x) - 1)]
            assert kept[s == name].tolist() == [not b for b in [False, *between, False][:len(x)]]
            for i, r in zip(x, run[s == name].tolist()):
                far = (abs(r) >> 32) * (1 if r > 0 else -1)
                assert i + far in x


def test_copies_are_one_passage(spark):
    text = prose(80)
    got = passages.shared(table(spark, [(5, text), (3, text), (9, text), (1, prose(20)), (2, prose(20))])).collect()
    assert sorted(tuple(r) for r in got) == [(5, 3, 0, 80, 0, 80, 1.0), (9, 3, 0, 80, 0, 80, 1.0)]
