"""Fill-in-the-middle transformation: a text is cut at two ranks and its pieces are put in another order.

The units (lines, words or code points) of a text form an indexable skip list. Every link of a lane carries
two widths, the units and the code points it jumps over. A cut rank is reached by going down the lanes and
adding widths, so both cuts give their place in code points without a walk over all units before them.

A row's cuts, and whether and how it is reordered, come from the SHA-256 of seed and id alone: the result does
not depend on partitions or retries. Documents stay where they are read; there is no shuffle.

Defined results: a null text counts as empty and stays plain with n = 0; a text that holds a sentinel stays
plain; a null id is hashed as no digits; texts of any length are cut whole; repeated rows give equal rows; equal
cuts give an empty middle; an empty table gives an empty table. All columns are kept, except that one called
like an output column (in any case) is replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import without
from .words import lean, pieces, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = re.compile("<[PSM]>")
#: What one unit of a text is; every text is the concatenation of its units.
UNITS = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "word": re.compile(r"\s*\S+\s*\Z|\s*\S+|\s+\Z"),
         "char": re.compile(r".", re.DOTALL)}
FANOUT = 4  # one unit in so many also stands in the next lane
COLUMNS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
           ("output", pa.string())]
SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class SkipList:
    """Units of one text in lanes; lane 0 links all units, a higher one about one in FANOUT of the lane below.

    A lane is a list of links (units, code points, place in the lane below). The height of a unit follows from
    its rank by a fixed mixing rule, so equal texts have equal lanes.
    """

    def __init__(self, widths: list[int]):
        self.units = len(widths)
        self.lanes: list[list[tuple[int, int, int]]] = [[(1, w, i + 1) for i, w in enumerate(widths)]]
        while len(self.lanes[-1]) > FANOUT:
            below = self.lanes[-1]
            lane, units, chars = [], 0, 0
            for place, (u, c, _) in enumerate(below, 1):
                units, chars = units + u, chars + c
                if (place * 0x9E3779B1 >> 8) % FANOUT == 0:
                    lane.append((units, chars, place))
                    units = chars = 0
            if not 0 < len(lane) < len(below):
                break
            self.lanes.append(lane)

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        units = chars = place = 0
        for lane in reversed(self.lanes):
            while place < len(lane) and units + lane[place][0] <= rank:
                units, chars = units + lane[place][0], chars + lane[place][1]
                place += 1
            place = lane[place - 1][2] if place else 0
        return chars


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a row."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def widths_of(text: str, unit: str) -> list[int]:
    if unit == "line":
        sizes = [len(x) + 1 for x in text.split("\n")]
        sizes[-1] -= 1
        return sizes if sizes[-1] else sizes[:-1]
    return [m.end() - m.start() for m in UNITS[unit].finditer(text)]


def rearranged(text: str, key: object, unit: str, rate: int, spm: int, seed: int
               ) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    widths = widths_of(text, unit)
    n = len(widths)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or SENTINEL.search(text):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    index = SkipList(widths)
    a, b = index.chars_before(low), index.chars_before(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "line", rate: int = 100,
              spm: int = 50, seed: int = 7) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output.

    ``rate`` of 100 rows are reordered, ``spm`` of 100 of those as suffix-prefix-middle.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")
    rows = without(docs, [n for n, _ in COLUMNS], keep=[id, text])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            done = [rearranged(body.decode("utf-8", "surrogateescape"), key, unit, rate, spm, seed)
                    for key, body in zip(batch.column(id).to_pylist(), texts(batch.column(text)))]
            cols = [pa.array([d[i] for d in done], kind) for i, (_, kind) in enumerate(COLUMNS[:-1])]
            out = pa.array([d[4].encode("utf-8", "surrogateescape") for d in done], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols, out],
                                             [*batch.schema.names, *(n for n, _ in COLUMNS)])

    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + [SCHEMA])
    return rows.mapInArrow(lean(task), schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone.

    No sentinel can arise where a piece meets one: a sentinel starts with ``<``, which occurs in it once. So the
    three sentinels split the output into exactly its pieces.
    """
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: units, form, cut sizes, digests of output and of the text rebuilt from it."""
    done = transform(docs.select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output"), 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
