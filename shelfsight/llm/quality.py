"""Quality rules: base rules, then cutoffs that adapt to each language and source.

Each document gets counts (words, symbols, repeated lines and words). Four ratios of them go into mergeable
KLL sketches, one per (language, source), merged over each language and over all. Cutoffs are upper fences: the
median plus a multiple of the spread between it and the upper quantiles. A group's fence is shrunk toward its
language's, and that toward the one of all, by its number of rows; it is at most a small multiple of the wider
one and never above a ceiling, so that a group full of junk can't raise its own. Documents are then joined with
the cutoffs of their group; one fails if a count is over the fence by more than the count's own noise.

Defined results: a null or empty text has no words and fails the base rules; null language or source is a
group of its own; repeated rows count as often as they stand; an empty table gives an empty result; further
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh, hinted, without, written
from .words import WordHashes, lean, pieces, texts, windows

MIN_WORDS = 50
SPACE = bytes([32, *range(9, 14)])
NOT_COUNTED = SPACE + bytes(range(0x80, 0xC0))  # white space and the later bytes of a character
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps"]
GROUP_ROWS = 200  # a group of so many rows weighs as much as the wider level it is shrunk toward
SPREAD = 4.0  # fence: median + SPREAD x standard deviations, as the upper quantiles show them
UPPER = {0.75: 0.6745, 0.9: 1.2816}  # quantile -> its distance from the median in standard deviations
WIDER = 2.0  # a fence is at most WIDER times that of the wider level
NOISE = 3.0  # standard deviations of a count that a document may be over its fence
SKETCH = 1600  # size of the sketches: ranks are off by about 0.2 %
LEAST = 0.001  # the least fence; most documents have none of the first three
#: Ratio -> (count, what it is a share of, count of a single event, highest fence of any group): symbols a word
#: character, repeated lines a line, words in repeated windows a word, capital letters a word character.
RATIOS = {"symbols": ("n_symbols", "word_chars", 1, 0.10), "dup_lines": ("n_dup_lines", "n_lines", 1, 0.40),
          "repeats": ("n_repeat_words", "n_words", 6, 0.30), "caps": ("n_caps", "word_chars", 1, 0.45)}


def counts_of(text: bytes, cache: WordHashes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    chars = len(text.translate(None, NOT_COUNTED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = 0
    if n >= 4:
        _, place, times = np.unique(windows(cache.of(words), 3), return_inverse=True, return_counts=True)
        twice = times[place] > 1
        if twice.any():
            hit = np.zeros(n, dtype=bool)
            for i in range(3):
                hit[i:n - 2 + i] |= twice
            repeats = int(hit.sum())
    caps = sum(c.isupper() for c in text.decode("utf-8", "replace")) if not text.islower() else 0
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines), caps


def counted(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts of each text."""
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + [f"`{prefix}{c}` bigint" for c in COUNTS])

    def task(batches: Iterator[pa.RecordBatch]):
        cache = WordHashes()
        for batch in pieces(batches, text):
            rows = np.array([counts_of(x, cache) for x in texts(batch.column(text))], dtype=np.int64)
            rows = rows.reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(rows[:, i]) for i in range(len(COUNTS)))],
                [*batch.schema.names, *(prefix + c for c in COUNTS)])

    return docs.mapInArrow(lean(task), schema)


def ratios(prefix: str = "") -> dict[str, F.Column]:
    return {name: F.coalesce(F.try_divide(F.col(prefix + part), F.col(prefix + whole)), F.lit(0.0))
            for name, (part, whole, _, _) in RATIOS.items()}


def over(name: str, fence: F.Column, prefix: str = "") -> F.Column:
    """Whether the count is over ``fence`` by more than its noise; events are taken as independent."""
    part, whole, event, _ = RATIOS[name]
    usual = fence * F.col(prefix + whole)
    return F.col(prefix + part) > usual + NOISE * event * F.sqrt(usual / event + 1)


def base_failed(prefix: str = "") -> F.Column:
    n, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeats > 50 * n)


def sketches(measured: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """One mergeable sketch per ratio and group."""
    return measured.groupBy(*keys).agg(
        F.count("*").alias("n_docs"),
        *(F.kll_sketch_agg_double(c.cast("double"), F.lit(SKETCH)).alias(name) for name, c in ratios(prefix).items()))


def merged(groups: DataFrame, keys: list[str]) -> DataFrame:
    return groups.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"),
                                     *(F.kll_merge_agg_double(name, F.lit(SKETCH)).alias(name) for name in RATIOS))


def cutoffs(groups: DataFrame, keys: list[str], group_rows: int = GROUP_ROWS, spread: float = SPREAD) -> DataFrame:
    """Upper fences of every group, shrunk toward its language's and the ones of all."""
    def fences(df: DataFrame, level: str) -> DataFrame:
        def fence(name: str):
            def at(rank: float):
                return F.kll_sketch_get_quantile_double(name, F.lit(rank))
            return at(0.5) + spread * F.greatest(*((at(rank) - at(0.5)) / far for rank, far in UPPER.items()))
        return df.select(*(k for k in keys if k in df.columns), F.col("n_docs").alias(f"{level}_docs"),
                         *(fence(name).alias(f"{level}_{name}") for name in RATIOS))

    own = fences(groups, "own")
    wide = fences(merged(groups, keys[:1]), "wide")
    whole = fences(merged(groups, []).where(F.col("n_docs") > 0), "whole")
    key = own[keys[0]].eqNullSafe(wide[keys[0]])
    joined = own.join(wide, key, "left").drop(wide[keys[0]]).join(F.broadcast(whole), how="left", on=F.lit(True))

    def shrunk(name: str):
        limit = F.greatest(F.lit(LEAST), F.least(F.lit(RATIOS[name][3]), F.col(f"whole_{name}")))
        for level in ("wide", "own"):
            weight = F.col(f"{level}_docs") / (F.col(f"{level}_docs") + group_rows)
            mine = F.greatest(F.lit(LEAST), F.least(F.col(f"{level}_{name}"), WIDER * limit, F.lit(RATIOS[name][3])))
            limit = weight * mine + (1 - weight) * limit
        return limit

    return joined.select(*keys, *(shrunk(name).alias(f"max_{name}") for name in RATIOS))


def scored(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
           prefix: str = "", group_rows: int = GROUP_ROWS, spread: float = SPREAD) -> DataFrame:
    """``docs`` with its counts, ``base_failed`` and ``kept`` (all named with ``prefix``), which replace columns
    of the same names."""
    docs = without(docs, [prefix + c for c in (*COUNTS, "base_failed", "kept")], keep=[text, lang, source])
    g, s = "group_lang", "group_source"
    measured = counted(docs.select(F.col(text).alias("t"), F.col(lang).alias(g), F.col(source).alias(s)), "t")
    groups = written(sketches(measured.where(~base_failed()).drop("t"), [g, s]), "quality-sketches")
    limits = cutoffs(groups, [g, s], group_rows, spread)
    limits = hinted(written(limits, "quality-cutoffs"), 100_000)
    limits = limits.toDF(*[f"{prefix}__{c}" for c in limits.columns])
    all_docs = counted(docs, text, prefix)
    joined = all_docs.join(limits, all_docs[lang].eqNullSafe(limits[f"{prefix}__{g}"])
                           & all_docs[source].eqNullSafe(limits[f"{prefix}__{s}"]), "left")
    failed = reduce(lambda a, b: a | b, (
        over(name, F.coalesce(F.col(f"{prefix}__max_{name}"), F.lit(RATIOS[name][3])), prefix) for name in RATIOS))
    return joined.select(*all_docs.columns, base_failed(prefix).alias(prefix + "base_failed"),
                         (~base_failed(prefix) & ~failed).alias(prefix + "kept"))


def kept_only(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, in their own columns."""
    mark = fresh(docs, "quality")
    while any(c.lower().startswith(mark + "_") for c in docs.columns):
        mark = "_" + mark
    return scored(docs, text, lang, source, mark + "_").where(F.col(f"{mark}_kept")).select(*docs.columns)
