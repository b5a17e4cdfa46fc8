"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are lower-cased (A-Z) and reduced to words of ASCII letters, digits and non-ASCII characters.
Windows of ten consecutive benchmark words are the patterns; a word alphabet (the words of the
benchmark) keeps the automaton small, and each text is scanned once, left to right. Hits are mapped
back to code points of the original text.

Defined results: a null or empty text has no words and no hits; an item without words has no window;
the windows of an item without an id are hit like others, but it is not counted among the items; equal items and
repeated rows count once per id; very long texts are scanned whole; further columns of the documents are kept,
except that the new ones replace columns of the same names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, without
from .words import ALNUM, lean, pieces, texts

WINDOW = 10
ITEM_BYTES = 32 << 20  # benchmark text per automaton: what the driver collects and broadcasts at once
HITS = "array<struct<start:int,stop:int,item:string>>"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class Patterns:
    """The automaton over word numbers; value of a pattern: its length and the items that have it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            width = min(window, len(ids))
            for i in range(len(ids) - width + 1):
                found.setdefault(tuple(ids[i:i + width]), set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in found.items():
            self.machine.add_word(key, (len(key), sorted(names, key=lambda x: (x is not None, x))))
        self.machine.make_automaton()
        self.any = bool(found)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str]]]:
        """Number of words, and (first word, word after the last, item) of each occurrence."""
        words = words_of(text)
        if not words or not self.any:
            return len(words), []
        number = self.numbers.get
        ids = tuple([number(w, 0) for w in words])
        return len(words), [(end - size + 1, end + 1, item)
                            for end, (size, names) in self.machine.iter(ids) for item in names]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
         item_text: str = "text", words: str = "n_words", hits: str = "hits", window: int = WINDOW,
         item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` with the number of words and the word spans that some benchmark window covers.

    The benchmark is read in blocks of a bounded size, one automaton each; the usual one fits a single block.
    No shuffle: documents stay where they are read.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    docs = without(docs, [words, hits], keep=[text])
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // item_bytes) + 1
    out = docs
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        shipped = docs.sparkSession.sparkContext.broadcast(
            [(r["item"], (r["text"] or "").encode()) for r in part.collect()])
        first = block == 0
        schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + [f"`{words}` bigint", f"`{hits}` {HITS}"])

        def task(batches: Iterator[pa.RecordBatch], shipped=shipped, first=first):
            machine = Patterns(shipped.value, window)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("item", pa.string())]))
            for batch in pieces(batches, text):
                found = [machine.scan(x) for x in texts(batch.column(text))]
                lists = [[{"start": a, "stop": b, "item": i} for a, b, i in h] for _, h in found]
                if not first:
                    lists = [(old or []) + new for old, new in zip(batch.column(hits).to_pylist(), lists)]
                cols = [batch.column(c) for c in batch.schema.names if first or c not in (words, hits)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array([n for n, _ in found], pa.int64()), pa.array(lists, kind)],
                    [c for c in batch.schema.names if first or c not in (words, hits)] + [words, hits])

        out = out.mapInArrow(lean(task), schema)
    return out


def covered(hits: F.Column) -> F.Column:
    """Number of words inside any span: spans by start, each adding what lies past the furthest end so far."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        F.array_sort(hits), start,
        lambda a, h: F.struct(F.greatest(a["end"], h["stop"]).alias("end"),
                              (a["n"] + F.greatest(F.lit(0), h["stop"] - F.greatest(a["end"], h["start"]))).alias("n")),
        lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, words hit, items found and their digest."""
    found = scan(docs.select("doc_id", "text"), benchmark, window=window)
    names = F.array_distinct(F.transform("hits", lambda h: h["item"]))
    items = F.array_sort(F.filter(names, lambda x: x.isNotNull()))
    return found.select(
        "doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def char_spans(text: str | None, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code points of the original text."""
    places = [m.span() for m in WORD.finditer(text or "")]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def original_spans(found: DataFrame, text: str = "text", hits: str = "hits", spans: str = "spans") -> DataFrame:
    """Add the hits of :func:`scan` as (start, stop, item) in code points of the original text."""
    schema = ", ".join([f"`{n}` {t}" for n, t in found.dtypes] + [f"`{spans}` {HITS}"])

    def task(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("item", pa.string())]))
        for batch in batches:
            rows = []
            for body, hs in zip(batch.column(text).to_pylist(), batch.column(hits).to_pylist()):
                places = char_spans(body, [(h["start"], h["stop"]) for h in hs]) if hs else []
                rows.append([{"start": a, "stop": b, "item": h["item"]} for (a, b), h in zip(places, hs or [])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, spans])

    return found.mapInArrow(lean(task), schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, in their own columns."""
    words = fresh(docs, "n_words")
    hits = fresh(docs, "hits")
    return scan(docs, benchmark, words=words, hits=hits).where(F.size(hits) == 0).select(*docs.columns)
