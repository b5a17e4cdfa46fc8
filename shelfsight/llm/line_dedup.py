"""Line dedup by distinct-site spread.

A line (trimmed of ASCII white space, not empty) found on at least ``min_sites`` distinct sites is
boilerplate: all but its first copy (smallest doc_id, then place) go. One HyperLogLog sketch of sites per line
hash is merged by the aggregation; lines whose estimate lies near the threshold get an exact distinct count.

Defined results: null text stays null, a null site counts for nothing, a document with a null doc_id never
holds the first copy unless no other does; empty lines stay; repeated rows of one doc_id all hold the first
copy; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import SMALL_ROWS, fresh, is_small, without, written
from .words import lean, pieces, texts

MIN_SITES = 5
SKETCH_BITS = 10
#: Relative band around the threshold that is counted exactly: four standard errors of the sketch.
BAND = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)
FAR_ID = (1 << 63) - 1


def line_hashes(text: bytes) -> list[int]:
    """The hash of every line; 0 for one without a word."""
    return [xxhash.xxh64_intdigest(x) or 1 if x else 0 for x in map(bytes.strip, text.split(b"\n"))]


def lines(docs: DataFrame, text: str, site: str, doc_id: str) -> DataFrame:
    """(line, site, doc) once per document and line."""
    narrow = docs.select(F.col(text).alias("text"), F.col(site).cast("string").alias("site"),
                         F.coalesce(F.col(doc_id).cast("bigint"), F.lit(FAR_ID)).alias("doc"))

    def task(batches: Iterator[pa.RecordBatch]):
        for batch in pieces(batches):
            found = [set(line_hashes(x)) - {0} for x in texts(batch.column("text"))]
            times = [len(x) for x in found]
            place = np.repeat(np.arange(len(found)), times)
            flat = np.fromiter((h for x in found for h in x), dtype=np.uint64, count=sum(times))
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat.view(np.int64)), batch.column("site").take(pa.array(place)),
                 batch.column("doc").take(pa.array(place))], ["line", "site", "doc"])

    return narrow.mapInArrow(lean(task), "line bigint, site string, doc bigint")


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id",
                min_sites: int = MIN_SITES) -> DataFrame:
    """(line, doc): each boilerplate line and the document that keeps it."""
    found = lines(docs, text, site, doc_id)
    spread = found.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sites"),
                                       F.min("doc").alias("doc"), F.count("*").alias("n"))
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    spread = spread.where(F.col("n") >= min_sites).select(
        "line", "doc", F.hll_sketch_estimate("sites").alias("estimate")).where(F.col("estimate") >= low)
    wide = written(spread, "line-spread")
    near = wide.where(F.col("estimate") <= high).select("line", F.col("doc").alias("keeper"))
    if not near.isEmpty():
        if is_small(near):
            near = F.broadcast(near)
        exact = found.join(near, "line").groupBy("line").agg(
            F.min("keeper").alias("doc"), F.count_distinct("site").alias("sites"))
        # pairs are reduced map-side first, so a line on every page is a few rows a task
        near = exact.where(F.col("sites") >= min_sites).select("line", "doc")
        return wide.where(F.col("estimate") > high).select("line", "doc").unionByName(near)
    return wide.select("line", "doc")


def strip(text: bytes, doc: int, line: np.ndarray, keeper: np.ndarray) -> tuple[bytes, int]:
    """``text`` without the boilerplate lines that ``doc`` doesn't keep, and how many went."""
    own = np.array(line_hashes(text), dtype=np.uint64).view(np.int64)
    place = np.minimum(np.searchsorted(line, own), max(0, len(line) - 1))
    known = (line[place] == own) if len(line) else np.zeros(len(own), bool)
    if not known.any():
        return text, 0
    first = np.zeros(len(own), bool)
    first[np.unique(own, return_index=True)[1]] = True
    gone = known & ~((keeper[place] == doc) & first) if len(line) else known
    if not gone.any():
        return text, 0
    return b"\n".join(x for x, g in zip(text.split(b"\n"), gone) if not g), int(gone.sum())


def without_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id",
                        min_sites: int = MIN_SITES, removed: str = "n_removed", total: str = "n_lines",
                        small_rows: int = SMALL_ROWS) -> DataFrame:
    """``docs`` with cleaned texts, the number of lines with a word, and the number removed.

    The boilerplate lines are broadcast when their checked number is at most ``small_rows`` (16 bytes each);
    otherwise each document is joined with those of its own lines that are boilerplate. The two new columns
    replace columns of the same names.
    """
    docs = without(docs, [total, removed], keep=[text, site, doc_id])
    spread = written(boilerplate(docs, text, site, doc_id, min_sites), "boilerplate")
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + [f"`{total}` bigint", f"`{removed}` bigint"])
    names = docs.columns

    def cleaned(batch: pa.RecordBatch, tables) -> pa.RecordBatch:
        body, gone, total_lines = [], [], []
        ids = batch.column(doc_id).cast(pa.int64()).fill_null(FAR_ID).to_pylist()
        nulls = batch.column(text).is_null().to_pylist()
        for x, doc, null, (line, keeper) in zip(texts(batch.column(text)), ids, nulls, tables):
            new, n = strip(x, doc, line, keeper)
            body.append(None if null else new.decode("utf-8", "replace"))
            gone.append(n)
            total_lines.append(sum(1 for y in x.split(b"\n") if y.strip()))
        cols = [pa.array(body, pa.string()) if c == text else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(total_lines, pa.int64()), pa.array(gone, pa.int64())], [*names, total, removed])

    if is_small(spread, small_rows):
        rows = spread.orderBy("line").toArrow()
        shipped = docs.sparkSession.sparkContext.broadcast(
            (rows.column("line").to_numpy(), rows.column("doc").to_numpy()))

        def task(batches: Iterator[pa.RecordBatch]):
            for batch in pieces(batches, text):
                yield cleaned(batch, [shipped.value] * batch.num_rows)

        return docs.mapInArrow(lean(task), schema)

    # Shuffled form: a document's key is its id and text, so repeated rows share one list of lines.
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(FAR_ID)), F.coalesce(F.col(text), F.lit("")))
    keyed = docs.select(key.alias("key"), F.struct(*names).alias("row"))
    own = keyed.select("key", F.col(f"row.{text}").alias("text"))

    def explode(batches: Iterator[pa.RecordBatch]):
        for batch in pieces(batches):
            found = [set(line_hashes(x)) - {0} for x in texts(batch.column("text"))]
            times = [len(x) for x in found]
            flat = np.fromiter((h for x in found for h in x), dtype=np.uint64, count=sum(times))
            place = pa.array(np.repeat(np.arange(len(found)), times))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(place), pa.array(flat.view(np.int64))], ["key", "line"])

    per_doc = own.mapInArrow(explode, "key bigint, line bigint").join(spread, "line") \
        .groupBy("key").agg(F.array_sort(F.collect_set(F.struct("line", "doc"))).alias("known"))
    wide = keyed.join(per_doc, "key", "left").select("row.*", F.col("known").alias("__known"))

    def task_wide(batches: Iterator[pa.RecordBatch]):
        for batch in pieces(batches, text):
            tables = []
            for known in batch.column("__known").to_pylist():
                known = known or []
                tables.append((np.array([k["line"] for k in known], np.int64),
                               np.array([k["doc"] for k in known], np.int64)))
            yield cleaned(batch, tables)

    return wide.mapInArrow(lean(task_wide), schema)


def deduped(docs: DataFrame) -> DataFrame:
    """Documents with cleaned texts in their own columns; those left without any word go."""
    total, removed = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    out = without_boilerplate(docs, total=total, removed=removed)
    return out.where(~((F.col(removed) > 0) & (F.col(removed) >= F.col(total)))).select(*docs.columns)
