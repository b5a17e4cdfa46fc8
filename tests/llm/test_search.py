"""Exact vector search, lexical search and infilling against brute force, with edge rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfsight.llm import block_search, infill, lexical

RNG = random.Random(11)


# --- op11 --------------------------------------------------------------------

def nearest(rows, every, k, scale=64):
    """(query, rank, id, score) by scoring everything."""
    good = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in good:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def vectors(spark, rows):
    schema = "vec_id bigint, embedding array<double>, rank string, score double"
    return spark.createDataFrame([(*r, "clash", 0.0) for r in rows], schema)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(block_search, "BLOCK_ROWS", 4)
    monkeypatch.setattr(block_search, "BUFFER_ROWS", 32)
    monkeypatch.setattr(block_search, "CHUNK_BYTES", 400)
    monkeypatch.setattr(block_search, "SHARD_BYTES", 4000)


def test_top_k_equals_scoring_everything(spark, small_blocks):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[rng.integers(6)] + rng.normal(size=8) * 0.3).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # a large group of equal vectors: ties by id
    rows += [(500, None), (520, [1.0, None]), (540, [1.0, float("nan")]), (560, [float("inf")]), (None, [1.0] * 8),
             (580, []), (600, [2.0, -1.0]), rows[0], rows[0], (40, [0.5] * 8)]
    for k in (3, 20):
        assert found(block_search.top_k(vectors(spark, rows), every=20, k=k)) == nearest(rows, 20, k)


def test_top_k_of_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (3, [-1.0, 0.0])]
    assert found(block_search.top_k(vectors(spark, rows))) == nearest(rows, 20, 20)
    assert found(block_search.top_k(vectors(spark, []))) == []
    assert found(block_search.top_k(vectors(spark, [(0, [1.0])]))) == []


def test_products_beyond_doubles_stay_exact(spark, small_blocks):
    rows = [(i, [float(2 ** 20 + i), float(2 ** 20 - i), 2.0 ** 22]) for i in range(60)]
    assert block_search.arithmetic(64 * 2.0 ** 22, 3) is object
    assert found(block_search.top_k(vectors(spark, rows), k=5)) == nearest(rows, 20, 5)


def test_blocks_are_passed_over():
    """Most blocks of well-separated groups are never scored."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 40
    x = np.repeat(centres, 64, axis=0) + rng.normal(size=(40 * 64, 16))
    x = np.floor(x).astype(np.int64)
    import pyarrow as pa
    made = block_search.cut(np.arange(len(x)), x, 20, 20, np.float64)
    blocks = block_search.Blocks(pa.table({f: pa.array([m[f].tolist() for m in made], pa.list_(pa.int64()))
                                           for f in ("ids", "rows", "most", "least")}), 16, np.float64)

    class Counted(np.ndarray):
        pass

    scored = []
    rows = blocks.rows

    class Watch:
        def __getitem__(self, span):
            scored.append(span)
            return rows[span]

    blocks.rows = Watch()
    ids = np.arange(0, len(x), 640)
    query, got, _ = blocks.search(x[ids].astype(float), ids, np.full(len(ids), block_search.LEAST), 20)
    for place, i in enumerate(ids):
        scores = x @ x[i]
        scores[i] = -10 ** 9
        assert got[query == place].tolist() == np.lexsort((np.arange(len(x)), -scores))[:20].tolist()
    assert len(scored) < len(blocks.ends) * len(ids) / 4


# --- op13 --------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def ranked(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scored = []
        for i, c in counts:
            m, s = 100 - 75 + (75 * sum(c.values()) * n_docs) // total, 0
            for t in terms(text):
                if tf := c.get(t):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (
                        (1000000000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def library():
    words = ["w%d" % i for i in range(60)] + ["Ünï", "été", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(RNG.choices(words, weights, k=RNG.randrange(1, 80)))) for i in range(400)]
    docs += [(i, docs[3][1]) for i in range(400, 440)]  # ties
    docs += [(440, None), (441, ""), (442, "...!"), (None, docs[5][1]), docs[7], docs[7],
             (443, " ".join(RNG.choices(words, k=30000))), (444, "W1-w1,W2")]
    items = [(i, " ".join(RNG.choices(words, weights, k=RNG.randrange(1, 12)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "unknown words only"), items[0], (33, docs[3][1]), (None, "w5 w6"),
              (34, "w7 w7 w7 w40")]
    return docs, items


def search(spark, docs, items, k):
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id bigint, text string, score string, n int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, rank int")
    out = lexical.search(d.repartition(3), b, k)
    return sorted((tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_scoring_everything(spark, library, monkeypatch):
    docs, items = library
    monkeypatch.setattr(lexical, "FIRST_READ", 2)
    for k in (1, 10):
        assert search(spark, docs, items, k) == ranked(docs, items, k)


def test_search_in_item_blocks_and_small_segments(spark, library, monkeypatch):
    docs, items = library
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", 300)
    monkeypatch.setattr(lexical, "SEGMENT_CELLS", 200)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    out = lexical.search(d.repartition(2), b, 10, item_bytes=300)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == ranked(docs, items, 10)


def test_search_of_empty_tables(spark):
    assert search(spark, [], [(1, "a")], 10) == search(spark, [(1, "a")], [], 10) == search(spark, [], [], 10) == []


def test_nra_stops_before_the_end_of_its_lists():
    """One rare term decides the ten best: the long list is read in part, and their scores are final."""
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop - key.start)
            return np.asarray(super().__getitem__(key))

    n = 50_000
    long = np.arange(n)
    docs = np.concatenate([long, long[:20]])
    impacts = np.concatenate([np.linspace(9000, 10, n).astype(np.int64), np.full(20, 10 ** 6)])
    index = lexical.sorted_lists(np.repeat([0, 1], [n, 20]), docs, impacts, 2)
    index = index._replace(docs=index.docs.view(Watched))
    got, scores = lexical.nra(lexical.Item(0, np.array([0, 1]), np.array([1, 1])), index, np.arange(n), 10, 0)
    want = sorted(((impacts[i] + (10 ** 6 if i < 20 else 0), i) for i in range(n)), reverse=True)[9][0]
    assert sorted(got[scores > want].tolist()) == [i for i in range(10) if impacts[i] + 10 ** 6 > want]
    assert all(s == impacts[i] + 10 ** 6 for i, s in zip(got, scores))
    assert sum(reads) < n / 10


# --- op12 --------------------------------------------------------------------

def test_skip_list_reaches_every_rank():
    for n in [0, 1, 2, 5, 17, 300, 5000]:
        widths = [RNG.randrange(0, 9) for _ in range(n)]
        index = infill.SkipList(widths)
        assert n < 100 or len(index.lanes) > 2
        for rank in {0, n, *(RNG.randrange(n + 1) for _ in range(60))}:
            assert index.chars_before(rank) == sum(widths[:rank])


def infilled(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(b"7:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_brute_force_and_restores(spark):
    texts = [None, "", "\n", "a", "a\nb", "a\nb\n", "\n\n\n", "x <P> y\nz", "<S", "<\n<\n<P\nS>\n", "é🦆\nü\n" * 40,
             "a<\nS>b\nP>c", "long " * 300_000 + "\n" + "end\n" * 5000, "\r\n \x0b\n\x00\n"]
    texts += ["".join(RNG.choice(["<", "P>", "S>", "M>", "\n", "ab", "ü"]) for _ in range(30)) for _ in range(150)]
    rows = [*enumerate(texts), (None, "a\nb\nc"), (5, texts[5]), (2 ** 62, "q\nr\ns\nt")]
    docs = spark.createDataFrame([(*r, "old", 1.5) for r in rows], "doc_id bigint, text string, Form string, x double")
    out = infill.transform(docs).withColumn("again", infill.restored(infill.F.col("output"), infill.F.col("form")))
    assert out.columns == ["doc_id", "text", "x", "n", "form", "prefix_chars", "middle_chars", "output", "again"]
    got = out.collect()
    assert sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got],
                  key=repr) == sorted([(i, *infilled(i, t)) for i, t in rows], key=repr)
    assert all(r["again"] == (r["text"] or "") and r["x"] == 1.5 for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["word", "char"])
def test_other_units_and_rates(spark, unit):
    texts = ["".join(RNG.choice("ab \n<é") for _ in range(RNG.randrange(0, 60))) for _ in range(120)]
    for text in texts:
        assert sum(infill.widths_of(text, unit)) == len(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = infill.transform(docs, unit=unit, rate=60, spm=0)
    rows = out.withColumn("again", infill.restored(infill.F.col("output"), infill.F.col("form"))).collect()
    assert all(r["again"] == r["text"] for r in rows)
    forms = Counter(r["form"] for r in rows)
    assert set(forms) == {"plain", "psm"} and 40 < forms["psm"] < 100
    with pytest.raises(ValueError):
        infill.transform(docs, unit="page")


def test_report_digests(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, None)], "doc_id bigint, text string")
    for r in infill.report(docs).collect():
        text = {1: "a\nb\nc", 2: ""}[r["doc_id"]]
        assert r["output_sha256"] == hashlib.sha256(infilled(r["doc_id"], text)[4].encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
