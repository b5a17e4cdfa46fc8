"""Ranked lexical search by NRA (Fagin, Lotem and Naor 2001): sequential reads of impact-sorted lists, no random access.

1. Every text is cut into terms once; a written forward index keeps each document's length and its counts of
   the items' terms. Collection statistics (documents, terms, document frequencies) are sums over that index.
2. The collection is split by document. A task turns its documents into impact-sorted lists, one a term, and
   runs NRA for every item over them. Reads keep a lower score for each document seen, and the values at the
   read positions bound what is still unseen. A list position moves on until the items' best documents, their
   ties and their final scores are all resolved. A task remembers each item's k-th best score so far: a later
   segment whose greatest impacts cannot reach it is not read at all.
3. Tasks give at most k rows an item; a ranking of these is the result.

Nothing is shuffled but frequencies and those few rows. The items are taken in blocks of bounded text; an
item's lists in one task are bounded by SEGMENT_POSTINGS.

Defined results: a null or empty text has no terms, is not counted as a document and is never found; an item
without terms finds nothing; equal scores go by ascending doc_id, null first; repeated document rows count and
rank as documents of their own; items equal in id and text count once; an item id with several texts is ranked
once for each text; texts of any length are read whole. Further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .words import ALNUM, lean, lists, pieces, texts

K = 10
SCALE = 1_000_000_000
FLAT = 25  # of a document's length measure, in hundredths; the rest goes with its length
SEGMENT_POSTINGS = 1 << 20
SEGMENT_CELLS = 1 << 26  # documents of a segment times terms of the longest item
FIRST_READ = 64  # entries of each list in the first round of sequential reads; doubles from round to round
ITEM_BYTES = 4 << 20  # item text whose terms are searched in one pass over the documents
NO_ID = np.iinfo(np.int64).min


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII digits and letters and non-ASCII characters, A-Z in lower case."""
    return text.translate(ALNUM).split()


class Item(NamedTuple):
    key: int
    terms: np.ndarray
    factors: np.ndarray  # weight times repeats


class Lists(NamedTuple):
    """Impact-sorted postings of one segment: entries of term t stand in starts[t]:starts[t + 1]."""
    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray


def forward_index(docs: DataFrame, terms: list[bytes], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of every document with at least one term."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shipped.value)}
        for batch in pieces(batches, text):
            found, counts, sizes = [], [], []
            for body in texts(batch.column(text)):
                words = terms_of(body)
                here = Counter(filter(number.__contains__, words))
                sizes.append(len(words))
                found.append(np.fromiter(map(number.__getitem__, here), np.int32, len(here)))
                counts.append(np.fromiter(here.values(), np.int32, len(here)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id).cast(pa.int64()), pa.array(sizes, pa.int64()), lists(found, pa.int32()),
                 lists(counts, pa.int32())], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id).cast("bigint").alias(id), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(lean(task), "doc_id bigint, n bigint, terms array<int>, counts array<int>").where("n > 0")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts_of(counts: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one unit of a term's weight adds to a document's score."""
    m = FLAT + ((100 - FLAT) * n * n_docs) // n_terms
    return (SCALE * counts) // (1000 * counts + 8 * m)


def sorted_lists(terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int) -> Lists:
    order = np.lexsort((docs, -impacts, terms))
    return Lists(np.searchsorted(terms[order], np.arange(n_terms + 1)), docs[order], impacts[order])


def nra(item: Item, index: Lists, ids: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, exact scores) of all that can be among the item's best ``k``: score above 0 and at least both
    ``floor`` and the k-th best score here. Ties at that score are all kept.
    """
    at, ends = index.starts[item.terms], index.starts[item.terms + 1]
    there = ends > at
    at, ends, factors = at[there], ends[there], item.factors[there]

    def frontier() -> np.ndarray:
        left = at < ends
        out = np.zeros(len(at), np.int64)
        out[left] = factors[left] * index.impacts[at[left]]
        return out

    unread = frontier()  # an upper bound of what each list can still add to a document
    none = np.zeros(0, np.int64)
    if not len(at) or unread.sum() < max(floor, 1):
        return none, none
    lower = np.zeros(len(ids), np.int64)
    seen = np.zeros((len(at), len(ids)), bool)
    touched = np.zeros(len(ids), bool)
    open_docs = none
    fresh, step = True, FIRST_READ  # fresh: an unseen document may still be among the best
    while True:
        for i in np.flatnonzero(at < ends):
            stop = min(ends[i], at[i] + step)
            part = index.docs[at[i]:stop]
            lower[part] += factors[i] * index.impacts[at[i]:stop]  # a document stands in a list once
            seen[i, part] = True
            touched[part] = True
            at[i] = stop
        step *= 2
        unread = frontier()
        rest = int(unread.sum())
        known = np.flatnonzero(touched) if fresh else open_docs
        threshold = max(floor, 1)
        if len(known) >= k:
            threshold = max(threshold, int(np.partition(lower[known], len(known) - k)[len(known) - k]))
        fresh = fresh and rest >= threshold
        upper = lower[known] + unread @ ~seen[:, known]
        open_docs = known[upper >= threshold]
        if not fresh and (upper == lower[known])[upper >= threshold].all():
            return open_docs, lower[open_docs]


class Search:
    """The running search of one task."""

    def __init__(self, items: list[Item], n_terms: int, k: int):
        self.items, self.n_terms, self.k = items, n_terms, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]  # doc ids and scores, best first

    def add(self, ids: np.ndarray, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> None:
        """Search one more segment of documents."""
        index = sorted_lists(terms, docs, impacts, self.n_terms)
        for i, item in enumerate(self.items):
            old_ids, old = self.best[i]
            floor = int(old[-1]) if len(old) >= self.k else 0
            found, scores = nra(item, index, ids, self.k, floor)
            if len(found):
                all_ids, all_scores = np.concatenate([old_ids, ids[found]]), np.concatenate([old, scores])
                order = np.lexsort((all_ids, -all_scores))[:self.k]
                self.best[i] = all_ids[order], all_scores[order]


def search(docs: DataFrame, items: DataFrame, k: int = K, id: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents, or all with a score if they are fewer."""
    asked = items.select(F.col(item).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // item_bytes) + 1
    out = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = _search_block(docs, part, k, id, text).withColumn("block", F.lit(block))
        out = found if out is None else out.unionByName(found)
    best_first = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return (out.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def _search_block(docs: DataFrame, asked: DataFrame, k: int, id: str, text: str) -> DataFrame:
    """(query, item_id, doc_id, score): up to ``k`` rows a task and item; items of a bounded size."""
    spark = docs.sparkSession
    rows = asked.collect()
    words = [Counter(terms_of((r["text"] or "").encode())) for r in rows]
    terms = sorted(set().union(*words))
    number = {t: i for i, t in enumerate(terms)}
    index = written(forward_index(docs, terms, id, text), "op13-index")
    total = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    seen = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    df = {r["term"]: r["df"] for r in seen}
    plans = []
    for key, counts in enumerate(words):
        factors = {number[t]: c * weight(total["docs"], df[number[t]]) for t, c in counts.items() if number[t] in df}
        wanted = np.array(sorted(t for t, f in factors.items() if f > 0), np.int64)
        plans.append(Item(key, wanted, np.array([factors[t] for t in wanted], np.int64)))
    shipped = spark.sparkContext.broadcast((plans, len(terms), total["docs"], max(total["terms"], 1)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n_terms, n_docs, all_terms = shipped.value
        running = Search(queries, n_terms, k)
        most = max(1, SEGMENT_CELLS // max([1, *(len(q.terms) for q in queries)]))
        held, size, rows = [], 0, 0

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            found, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
            sizes = np.diff(found.offsets.to_numpy())
            place = np.repeat(np.arange(table.num_rows), sizes)
            length = table.column("n").to_numpy()[place]
            amounts = counts.flatten().to_numpy().astype(np.int64)
            running.add(table.column("doc_id").fill_null(int(NO_ID)).to_numpy(), found.flatten().to_numpy(), place,
                        impacts_of(amounts, length, n_docs, all_terms))

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                postings = len(part.column("terms").flatten())
                if held and (rows + part.num_rows > most or size + postings > SEGMENT_POSTINGS):
                    flush()
                    held, size, rows = [], 0, 0
                held.append(part)
                size, rows = size + postings, rows + part.num_rows
        if held:
            flush()
        keys = np.repeat([q.key for q in queries], [len(ids) for ids, _ in running.best])
        if len(keys):
            ids, scores = (np.concatenate([b[i] for b in running.best]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array(ids, mask=ids == NO_ID, type=pa.int64()), pa.array(scores)],
                ["query", "doc_id", "score"])

    found = index.mapInArrow(lean(task), "query int, doc_id bigint, score bigint")
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                  f"query int, item_id {dict(asked.dtypes)['item_id']}")
    # as many rows as items in the block, whose text is bounded
    return found.join(F.broadcast(names), "query").select("query", "item_id", "doc_id", "score")
