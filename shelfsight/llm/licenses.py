"""Licence scans: normalised text against licence templates, by the Dice coefficient over word bigrams.

Text is lower-cased and reduced to words of letters, digits and inner dots. A template of t bigrams is compared
with windows of every size w that can reach the threshold d, from t d / (2 - d) to t (2 - d) / d; the coefficient is
2 x shared bigrams / (w + t), counted as multisets. A text skips the template if it has fewer bigrams, or fewer of
the template's, than the smallest match must have. Of overlapping matches the better one stays, then the
earlier, then the longer template.

Defined results: a null, empty or one-word text matches nothing; repeated rows stay rows; a template with fewer
than two words is refused; further columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import without
from .words import WordHashes, lean, pieces, windows

THRESHOLD = 0.8
MAX_TEMPLATES = 10_000  # templates are broadcast; more are refused
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
FOUND = "array<struct<start:int,stop:int,license:string,dice:double>>"
#: Usual notices of public licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "under the terms of the GNU General Public License as published by the Free Software Foundation, "
                "either version 3 of the License, or any later version"],
    "GPL-2.0": ["under the terms of the GNU General Public License as published by the Free Software Foundation, "
                "either version 2 of the License, or any later version"],
    "LGPL-2.1": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
                 "either version 2.1 of the License, or any later version"],
    "LGPL-3.0": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
                 "either version 3 of the License, or any later version"],
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
                 "either version 3 of the License, or any later version"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "BSD-2-Clause": ["Redistributions of source code must retain the above copyright notice, this list of conditions and "
                     "the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
                     "this list of conditions and the following disclaimer in the documentation and/or other materials "
                     "provided with the distribution"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0"],
    "All-rights-reserved": ["All rights reserved"],
}


def normal(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Template:
    def __init__(self, name: str, words: list[str], cache: WordHashes):
        if len(words) < 2:
            raise ValueError(f"{name}: a template needs two words")
        self.name, self.size = name, len(words)
        grams = windows(cache.of([w.encode() for w in words]), 2)
        self.grams = Counter(grams.tolist())
        self.keys = np.unique(grams)


class Templates:
    """All templates, with one index from bigrams to the templates that have them.

    A text's bigrams are looked up once for all templates; a template is only compared if the text has as many of its
    bigrams as the shortest window that can reach the threshold.
    """

    def __init__(self, templates: list[Template], threshold: float):
        self.all = templates
        keys = np.concatenate([t.keys for t in templates]) if templates else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(templates)), [len(t.keys) for t in templates])
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = np.unique(keys[order], return_index=True)
        self.owner, self.stops = owner[order], np.append(self.starts[1:], len(keys))
        self.least = np.array([least_shared(t.size - 1, threshold) for t in templates], np.int64)

    def near(self, grams: np.ndarray) -> list[tuple[Template, np.ndarray]]:
        """Templates that can match, with the places of their bigrams in the text."""
        if not len(self.keys):
            return []
        place = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[place] == grams)
        if not len(at):
            return []
        place = place[at]
        size = self.stops[place] - self.starts[place]
        ends = np.cumsum(size)
        owner = self.owner[np.arange(ends[-1]) + np.repeat(self.starts[place] - (ends - size), size)]
        where = np.repeat(at, size)
        counts = np.bincount(owner, minlength=len(self.all))
        return [(self.all[k], where[owner == k]) for k in np.flatnonzero(counts >= self.least)]


def least_shared(size: int, threshold: float) -> int:
    """Bigrams that the shortest window reaching the threshold shares with a template of ``size`` bigrams."""
    return int(np.ceil(threshold / 2 * (size * threshold / (2 - threshold) + size) - 1e-9))


def best_windows(grams: np.ndarray, template: Template, threshold: float, places: np.ndarray | None = None
                 ) -> list[tuple[float, int, int]]:
    """(coefficient, first bigram, end) of every window that reaches the threshold, of any size.

    A window that begins or ends with a bigram the template lacks is worse than the one without it. ``places`` are
    those of the template's bigrams, if known.
    """
    size = template.size - 1
    longest, least = size * (2 - threshold) / threshold, least_shared(size, threshold)
    if len(grams) < least:
        return []  # too small a text
    if places is None:
        places = np.flatnonzero(np.isin(grams, template.keys))
    if len(places) < least:
        return []  # too few shared bigrams
    stops = np.searchsorted(places, places + int(longest + 1e-9))
    out = []
    for i in np.flatnonzero(stops - np.arange(len(places)) >= least).tolist():
        own, shared, first = Counter(), 0, int(places[i])
        for place in places[i:stops[i]].tolist():
            g = int(grams[place])
            own[g] += 1
            shared += own[g] <= template.grams[g]
            dice = 2 * shared / (place + 1 - first + size)
            if dice >= threshold - 1e-12:
                out.append((dice, first, place + 1))
    return out


def scan_text(text: str, templates: Templates, cache: WordHashes, threshold: float) -> list[dict]:
    """Matches in ``text``, in code points, apart from one another and in order."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer: keep offsets of the original
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans = [m.span() for m in WORD.finditer(lowered)]
    if len(spans) < 2:
        return []
    grams = windows(cache.of([lowered[a:b].encode() for a, b in spans]), 2)
    found = [(-dice, s, -t.size, t.name, stop + 1)
             for t, places in templates.near(grams) for dice, s, stop in best_windows(grams, t, threshold, places)]
    if not found:
        return []
    taken, out = np.zeros(len(spans), bool), []
    for dice, s, _, name, stop in sorted(found):
        if not taken[s:stop].any():
            taken[s:stop] = True
            out.append({"start": spans[s][0], "stop": spans[stop - 1][1], "license": name, "dice": -dice})
    return sorted(out, key=lambda x: x["start"])


def scan(docs: DataFrame, text: str = "text", found: str = "licenses", templates: dict[str, list[str]] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the licence notices of each text, in place of a column called ``found``; nothing is shuffled."""
    docs = without(docs, [found], keep=[text])
    chosen = [(name, normal(body)) for name, bodies in (templates or TEMPLATES).items() for body in bodies]
    if len(chosen) > MAX_TEMPLATES:
        raise ValueError(f"{len(chosen)} templates; at most {MAX_TEMPLATES} are broadcast")
    shipped = docs.sparkSession.sparkContext.broadcast(chosen)
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + [f"`{found}` {FOUND}"])

    def task(batches: Iterator[pa.RecordBatch]):
        cache = WordHashes()
        known = Templates([Template(name, words, cache) for name, words in shipped.value], threshold)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("license", pa.string()),
                                   ("dice", pa.float64())]))
        for batch in pieces(batches, text):
            rows = [scan_text(x or "", known, cache, threshold) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, found])

    return docs.mapInArrow(lean(task), schema)


def template_table(rows: DataFrame, name: str = "license", text: str = "text") -> dict[str, list[str]]:
    """Templates from a table: a name and a text a row, such as full licence texts. Rows without a name or with fewer
    than two words are no templates; more than MAX_TEMPLATES are refused."""
    found: dict[str, list[str]] = {}
    some = rows.where(F.col(name).isNotNull() & F.col(text).isNotNull()).select(name, text).distinct()
    for r in some.orderBy(name, text).limit(MAX_TEMPLATES + 1).collect():
        if len(normal(r[text])) > 1:
            found.setdefault(r[name], []).append(r[text])
    return found


def report(docs: DataFrame) -> DataFrame:
    """One row per document: number of notices, the licences, the spans."""
    rows = scan(docs.select("doc_id", "text"))
    spans = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["stop"].cast("string")))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"])))
    return rows.select("doc_id", F.size("licenses").cast("bigint").alias("n_notices"),
                       F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"),
                       F.round(F.array_max(F.transform("licenses", lambda m: m["dice"])), 6).alias("best_dice"))
