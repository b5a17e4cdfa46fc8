"""Exact Jaccard self-join on word shingles, with set-relation skipping.

A document's set: its distinct five-word shingles, lower-cased. Documents link when
100 x intersection >= 80 x union. The steps:

1. Equal sets become one class (``cls``, a 64-bit hash of the set); all later work is on classes.
2. The global order of tokens puts rare ones first. Each task packs the top 32 bits of its shingles into sorted
   differences; reducers count them by range and give back a bit map of fixed size per frequency (2, 4, 8, ...),
   and the smallest frequency whose map is sparse enough is shipped. Any order gives right results; this one
   keeps shared passages out of the index unless nearly the whole text is shared.
3. Every class puts the tokens of its prefix (size - ceil(0.8 size) + 1 of them) into the inverted index, but
   for those that the map proves to be unique. Lists are sorted by size. Neighbours in a list whose sizes fit are
   joined into a block; where sizes don't fit, the chain breaks and whole blocks are skipped. Lists of frequent
   tokens are salted.
4. Blocks that share classes form clusters; only classes of one cluster can link. Shared passages may chain many
   classes into one, so clusters are refined: from the overlap of two prefixes follows a bound for the whole
   overlap, and only pairs that keep it stay connected.
5. A cluster's prefixes, and then the whole sets of a refined one, are dealt to tasks, a large cluster in pairs
   of parts. In a task, the overlap counts of a set with all others are derived from those of the set before it,
   by the index lists of the few tokens in which both differ, when that is less work than starting anew. Lists are
   by size, so only the range of fitting sizes is compared. What leaves the task is a spanning forest of links.

Defined results: null, empty and wordless texts have an empty set and link with nothing; fewer than five words
make one shingle; a null doc_id has a null component unless it links with a document that has one; repeated rows
stay rows; further columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .store import hinted, written
from .words import WordHashes, lean, lists, longs, pieces, runs, texts, windows

WIDTH = 5
PERCENT = 80
RANGES = 4096  # of the top 32 bits of a shingle
MAP_BITS = 27  # the bit map of frequent shingles takes 2**27 bits, 16 MB, whatever the size of the corpus
MAP_SHARE = 0.125  # and is of use while at most this share of its bits is set
STEPS = [2 ** k for k in range(1, 25)]  # frequencies that have a map
CHUNK_SHINGLES = 1_000_000
RANGE_VALUES = 4_000_000  # values of a range that are sorted at once; more are counted slot by slot
SALTED = 1_000  # an index list is salted if its token may be in more than one in so many documents
SALTS = 32
PART_PREFIX = 1_000_000  # tokens of prefixes that a part of a cluster holds
PART_SHINGLES = 500_000  # tokens of a cluster's part that a task holds; two parts at a time
NO_ID = -(1 << 63)


def shingle_set(text: bytes, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.lower().split()
    return np.unique(windows(cache.of(words), WIDTH)) if words else np.zeros(0, np.uint64)


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of the set; 0 for the empty one."""
    if not len(shingles):
        return 0
    return (xxhash.xxh64_intdigest(shingles.tobytes()) or 1) - (1 << 63)


def pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as their differences in 16 bits, or plainly where a difference is larger."""
    gaps = np.diff(values)
    if len(gaps) and int(gaps.max()) >= 1 << 16:
        return b"\0" + values.tobytes()
    return b"\1" + values[:1].tobytes() + gaps.astype(np.uint16).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if packed[0] == 0:
        return np.frombuffer(packed, np.uint32, offset=1)
    first, gaps = np.frombuffer(packed[1:5], np.uint32), np.frombuffer(packed, np.uint16, offset=5)
    return np.cumsum(np.append(first, gaps), dtype=np.uint64).astype(np.uint32)


def measured(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """kind 0: (doc_id, size, class) of each document; kind 1: a range's shingles in a chunk, packed."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    names = ["kind", "id", "n", "cls", "packed"]

    def task(batches: Iterator[pa.RecordBatch]):
        cache, seen, held, n_held = WordHashes(), set(), [], 0

        def ranges():
            values = np.sort((np.concatenate(held) >> np.uint64(32)).astype(np.uint32))
            starts = np.searchsorted(values, np.arange(RANGES, dtype=np.uint64) << np.uint64(20))
            full = [r for r, (a, b) in enumerate(zip(starts, np.append(starts[1:], len(values)))) if b > a]
            ends = np.append(starts[1:], len(values))
            k = len(full)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, np.int32)), pa.array(full, pa.int64()), pa.nulls(k, pa.int64()),
                 pa.nulls(k, pa.int64()), pa.array([pack(values[starts[r]:ends[r]]) for r in full], pa.binary())], names)

        for batch in pieces(batches):
            sets = [shingle_set(x, cache) for x in texts(batch.column("text"))]
            classes = [class_of(s) for s in sets]
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(classes, pa.int64()), pa.nulls(n, pa.binary())], names)
            for s, c in zip(sets, classes):
                if len(s) and c not in seen:
                    seen.add(c)
                    held.append(s)
                    n_held += len(s)
            if n_held >= CHUNK_SHINGLES:
                yield ranges()
                held, n_held = [], 0
        if n_held:
            yield ranges()

    return narrow.mapInArrow(lean(task), "kind int, id bigint, n bigint, cls bigint, packed binary")


def frequency_maps(packed: DataFrame) -> DataFrame:
    """(range, step, bits, slice): the part of each frequency's bit map that a range of shingles fills."""
    fold = 32 - MAP_BITS
    width = (1 << MAP_BITS) // RANGES

    def maps_of(r: int, held: list[np.ndarray], counts: np.ndarray | None) -> pa.RecordBatch | None:
        if counts is None:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            slots = (values & np.uint32((1 << 20) - 1)) >> np.uint32(fold)
        else:
            counts = added(held, counts) if held else counts
            slots, times = np.flatnonzero(counts) >> fold, counts[counts > 0]
        rows = []
        for step in STEPS:
            chosen = slots[times >= step]
            if not len(chosen):
                break
            bits = np.zeros(width, bool)
            bits[chosen] = True
            rows.append((r, step, int(bits.sum()), np.packbits(bits).tobytes()))
        if not rows:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            ["range", "step", "bits", "slice"])

    def added(held: list[np.ndarray], counts: np.ndarray | None) -> np.ndarray:
        more = np.bincount(np.concatenate(held) & np.uint32((1 << 20) - 1), minlength=1 << 20)
        return more if counts is None else counts + more

    def task(batches: Iterator[pa.RecordBatch]):
        last, held, n, counts = None, [], 0, None  # a range streams through; what is held of it is bounded
        for batch in batches:
            for r, x in zip(batch.column("id").to_pylist(), batch.column("packed").to_pylist()):
                if r != last:
                    if last is not None and (made := maps_of(last, held, counts)) is not None:
                        yield made
                    last, held, n, counts = r, [], 0, None
                held.append(unpack(x))
                n += len(held[-1])
                if n >= RANGE_VALUES:
                    counts, held, n = added(held, counts), [], 0
        if last is not None and (made := maps_of(last, held, counts)) is not None:
            yield made

    return packed.repartition("id").sortWithinPartitions("id") \
        .mapInArrow(lean(task), "range bigint, step bigint, bits bigint, slice binary")


class Frequent:
    """``often``, a bit map of fixed size, puts a token late in the order; ``hot``, the sorted places of the few most
    frequent ones (at most SALTED x shingles of a mean document), salts its list."""

    def __init__(self, step: int, often: np.ndarray, hot: np.ndarray):
        self.proves_unique = step == 2  # a token that isn't in the map of frequency 2 is in one class only
        self.often, self.hot = often, hot

    @staticmethod
    def slots(tokens: np.ndarray) -> np.ndarray:
        return (tokens >> np.uint64(64 - MAP_BITS)).astype(np.int64)

    def is_often(self, tokens: np.ndarray) -> np.ndarray:
        slot = self.slots(tokens)
        return (self.often[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1

    def is_hot(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(tokens), bool)
        slot = self.slots(tokens)
        return self.hot[np.minimum(np.searchsorted(self.hot, slot), len(self.hot) - 1)] == slot


def frequent(maps: DataFrame, n_docs: int) -> Frequent:
    filled = {r["step"]: r["bits"] for r in maps.groupBy("step").agg(F.sum("bits").alias("bits")).collect()}
    step = next((s for s in STEPS if filled.get(s, 0) <= MAP_SHARE * 2 ** MAP_BITS), STEPS[-1])
    hot = next(s for s in STEPS if s >= min(STEPS[-1], max(64, n_docs / SALTED)))

    size = (1 << MAP_BITS) // 8 // RANGES

    def slices(chosen: int):
        for row in maps.where(F.col("step") == chosen).select("range", "slice").toLocalIterator():
            yield row["range"], np.frombuffer(row["slice"], np.uint8)

    often = np.zeros(size * RANGES, np.uint8)
    for k, bits in slices(step):
        often[k * size:(k + 1) * size] = bits
    places = [k * size * 8 + np.flatnonzero(np.unpackbits(bits)) for k, bits in slices(hot)]
    return Frequent(step, often, np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64))


def prefix(shingles: np.ndarray, order: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """The tokens a set is indexed under, and which of them have a salted list."""
    n = len(shingles)
    often = order.is_often(shingles)
    at = np.argsort(often, kind="stable")[:n - (PERCENT * n + 99) // 100 + 1]
    if order.proves_unique:
        at = at[often[at]]
    chosen = shingles[at]
    return chosen, order.is_hot(chosen)


def index(docs: DataFrame, order, text: str) -> DataFrame:
    """(cls, n, tokens, salts): the tokens each class is indexed under; a class once per task."""
    def task(batches: Iterator[pa.RecordBatch]):
        cache, seen = WordHashes(), set()
        for batch in pieces(batches):
            tokens, salts, sizes, names = [], [], [], []
            for x in texts(batch.column("text")):
                s = shingle_set(x, cache)
                c = class_of(s)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                t, hot = prefix(s, order.value)
                if not len(t):
                    continue
                tokens.append(t)
                salts.append(np.where(hot, 1 + c % SALTS, 0).astype(np.int32))
                sizes.append(len(s))
                names.append(c)
            if not names:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), lists([longs(t) for t in tokens], pa.int64()),
                 lists(salts, pa.int32())], ["cls", "n", "tokens", "salts"])

    return docs.select(F.col(text).alias("text")) \
        .mapInArrow(lean(task), "cls bigint, n int, tokens array<bigint>, salts array<int>")


def block_edges(indexed: DataFrame) -> DataFrame:
    """(a, b): neighbours of an index list whose sizes fit; whoever can link in a list is joined by a chain of them."""
    chain = Window.partitionBy("token", "salt").orderBy("n", "cls")
    band = F.floor(F.log(100 / PERCENT, F.col("n")))
    listed = indexed.select("cls", "n", F.explode(F.arrays_zip("tokens", "salts")).alias("t")) \
        .select(F.col("t.tokens").alias("token"), F.col("t.salts").alias("salt"), "n", "cls")
    rows = listed.withColumn("band", band).select(
        "token", "salt", "n", "cls", "band", F.lag("cls").over(chain).alias("before"),
        F.lag("n").over(chain).alias("n_before"), F.lag("band").over(chain).alias("band_before"))
    fits = F.col("before").isNotNull() & (F.col("before") != F.col("cls")) \
        & (100 * F.col("n_before") >= PERCENT * F.col("n"))
    head = (F.col("salt") > 0) & ~F.col("band").eqNullSafe(F.col("band_before"))
    rows = written(rows.where(fits | head).withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("head", head),
                   "join-blocks")
    # A salted list: the first class of each size band in each salt stands for it, chained more loosely.
    across = Window.partitionBy("token").orderBy("n", "cls")
    heads = rows.where("head").select("token", "n", "cls", F.lag("cls").over(across).alias("before"),
                                      F.lag("n").over(across).alias("n_before"))
    loose = (100 * 100 * F.col("n_before") >= PERCENT * PERCENT * F.col("n")) & (F.col("before") != F.col("cls"))
    return rows.where("fits").select(F.col("cls").alias("a"), F.col("before").alias("b")) \
        .unionByName(heads.where(loose).select(F.col("cls").alias("a"), F.col("before").alias("b"))).distinct()


def jaccard_holds(n: int, sizes: np.ndarray, both: np.ndarray) -> np.ndarray:
    return 100 * both >= PERCENT * (n + sizes - both)


def prefix_bound_holds(n: int, sizes: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets whose prefixes share ``both`` tokens can link: past the prefix that ends first in the order,
    no more can be shared than its set has left."""
    left = np.maximum((PERCENT * n + 99) // 100, (PERCENT * sizes + 99) // 100) - 1
    return (100 + PERCENT) * (both + left) >= PERCENT * (n + sizes)


class Links:
    """Links among the sets of one part, or between two parts."""

    def __init__(self, names: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, holds=jaccard_holds):
        order = np.argsort(sizes, kind="stable")
        self.names, self.sets, self.sizes, self.holds = names[order], [sets[i] for i in order], sizes[order], holds
        flat = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        by_token = np.argsort(flat, kind="stable")  # owners stay in order of size
        self.owner = owner[by_token]
        self.tokens, self.starts = np.unique(flat[by_token], return_index=True)
        self.stops = np.append(self.starts[1:], len(flat))

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` each set holds, read off the index lists."""
        place = np.searchsorted(self.tokens, tokens)
        inside = place < len(self.tokens)
        place, tokens = place[inside], tokens[inside]
        place = place[self.tokens[place] == tokens]
        if not len(place):
            return np.zeros(len(self.sets), np.int64)
        size = self.stops[place] - self.starts[place]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.starts[place] - (ends - size), size)
        return np.bincount(self.owner[at], minlength=len(self.sets))

    def forest(self, names: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray) -> list[tuple[int, int]]:
        """A spanning forest of the links between ``sets`` and the indexed ones."""
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found, before, counts = [], None, None
        for name, tokens, n in zip(names.tolist(), sets, sizes.tolist()):
            low = int(np.searchsorted(self.sizes, -(-PERCENT * n // 100)))
            high = int(np.searchsorted(self.sizes, 100 * n // PERCENT, side="right"))
            if low >= high:
                continue  # no fitting size: the block is skipped
            if before is not None:
                gone = np.setdiff1d(before, tokens, assume_unique=True)
                come = np.setdiff1d(tokens, before, assume_unique=True)
            if before is not None and len(gone) + len(come) < len(tokens):
                counts = counts - self.overlaps(gone) + self.overlaps(come)
            else:
                counts = self.overlaps(tokens)
            before = tokens
            both = counts[low:high]
            for k in (low + np.flatnonzero(self.holds(n, self.sizes[low:high], both))).tolist():
                other = int(self.names[k])
                x, y = find(name), find(other)
                if x != y:
                    root[x] = y
                    found.append((name, other))
        return found


def similar_order(sets: list[np.ndarray]) -> list[int]:
    """Sets in an order that puts alike ones together: by their smallest tokens."""
    return sorted(range(len(sets)), key=lambda i: sets[i][:4].tolist())


def part_links(names: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, part: np.ndarray, i: int, j: int,
               holds) -> pa.RecordBatch | None:
    """A spanning forest of the links between parts ``i`` and ``j`` of a cluster."""
    once = np.zeros(len(names), bool)
    once[np.unique(names, return_index=True)[1]] = True  # tasks may bring the same class
    right, left = np.flatnonzero((part == j) & once), np.flatnonzero((part == i) & once)
    if not len(left) or not len(right):
        return None
    linked = Links(names[right], [sets[k] for k in right], sizes[right], holds)
    left = left[similar_order([sets[k] for k in left])]
    found = linked.forest(names[left], [sets[k] for k in left], sizes[left])
    if not found:
        return None
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


KEYS = ["cluster", "i", "j"]


def deal(rows: DataFrame, clusters: DataFrame, weights: DataFrame, on: list[str], part_shingles: int) -> DataFrame:
    """``rows`` (by ``cls``) with the cluster and each pair of parts they belong to, sorted by them."""
    parts = weights.select("cluster", F.greatest(F.lit(1), F.ceil(F.col("total") / part_shingles)).cast("int").alias("parts"))
    placed = hinted(written(clusters.join(parts, "cluster"), "join-placed"))
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(
        F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    dealt = rows.join(placed, on).withColumn("part", part).withColumn("pair", F.explode(pairs))
    return dealt.select("cluster", "pair.i", "pair.j", "part", *rows.columns) \
        .repartition(*KEYS).sortWithinPartitions(*KEYS, "cls")


def refined(indexed: DataFrame, clusters: DataFrame, part_tokens: int) -> DataFrame:
    """(a, b) of the classes whose prefixes leave a link possible, as spanning forests."""
    rows = indexed.select("cls", "n", "tokens")
    weights = rows.join(hinted(clusters), "cls").groupBy("cluster").agg(F.sum(F.size("tokens")).alias("total"))
    dealt = deal(rows, clusters, weights, ["cls"], part_tokens)

    def task(batches: Iterator[pa.RecordBatch]):
        for group in runs(batches, KEYS):
            column = group.column("tokens").combine_chunks()
            flat, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            sets = [np.sort(flat[a:b]) for a, b in zip(ends, ends[1:])]
            found = part_links(group.column("cls").to_numpy(), sets, group.column("n").to_numpy().astype(np.int64),
                               group.column("part").to_numpy(), group.column("i")[0].as_py(),
                               group.column("j")[0].as_py(), prefix_bound_holds)
            if found is not None:
                yield found

    return dealt.mapInArrow(lean(task), "a bigint, b bigint")


def cluster_links(dealt: DataFrame) -> DataFrame:
    """(a, b) from rows (cluster, i, j, part, cls, shingles): one task run per pair of parts."""
    def task(batches: Iterator[pa.RecordBatch]):
        for group in runs(batches, KEYS):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("shingles").to_pylist()]
            found = part_links(group.column("cls").to_numpy(), sets, np.array([len(x) for x in sets], np.int64),
                               group.column("part").to_numpy(), group.column("i")[0].as_py(),
                               group.column("j")[0].as_py(), jaccard_holds)
            if found is not None:
                yield found

    return dealt.mapInArrow(lean(task), "a bigint, b bigint")


def class_sets(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(cls, holder, shingles) of every document with words."""
    def task(batches: Iterator[pa.RecordBatch]):
        cache = WordHashes()
        for batch in pieces(batches):
            sets = [shingle_set(x, cache) for x in texts(batch.column("text"))]
            full = [k for k, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(sets[k]) for k in full], pa.int64()), batch.column("id").take(pa.array(full, pa.int64())),
                 pa.array([sets[k].tobytes() for k in full], pa.binary())], ["cls", "holder", "shingles"])

    holder = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))
    return docs.select(holder.alias("id"), F.col(text).alias("text")) \
        .mapInArrow(lean(task), "cls bigint, holder bigint, shingles binary")


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
           part_shingles: int = PART_SHINGLES, part_prefix: int = PART_PREFIX) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, n_shingles, cls) and links (a, b) between classes that span every component."""
    spark = docs.sparkSession
    facts = written(measured(docs, text, doc_id), "join-facts")
    members = facts.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "cls")
    maps = written(frequency_maps(facts.where("kind = 1").select("id", "packed")), "join-maps")
    order = spark.sparkContext.broadcast(frequent(maps, members.count()))
    indexed = written(index(docs, order, text), "join-index")

    def clustered(edges: DataFrame) -> DataFrame:
        return written(components(edges, "join-clusters").withColumnRenamed("node", "cls")
                       .withColumnRenamed("root", "cluster"), "join-clusters")

    clusters = clustered(refined(indexed, clustered(block_edges(indexed)), part_prefix))
    # one document brings the set of its class
    holders = members.groupBy("cls").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("holder"),
                                         F.first("n_shingles").alias("n"))
    clusters = written(clusters.join(holders, "cls"), "join-holders")
    weights = clusters.groupBy("cluster").agg(F.sum("n").alias("total"))
    dealt = deal(class_sets(docs, text, doc_id), clusters.drop("n"), weights, ["cls", "holder"], part_shingles)
    return members, cluster_links(dealt)


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
            part_shingles: int = PART_SHINGLES, part_prefix: int = PART_PREFIX) -> DataFrame:
    """(doc_id, n_shingles, cls, component_id) of every document."""
    members, links = linked(docs, text, doc_id, part_shingles, part_prefix)
    roots = components(links, "join-links").withColumnRenamed("node", "cls")
    classes = members.where("n_shingles > 0").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n"))
    labelled = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_docs")) \
        .where("n_docs > 1")
    named = written(labelled.select("cls", "root").join(least, "root").select("cls", "component_id"), "join-names")
    return members.join(named, "cls", "left").select(
        "doc_id", "n_shingles", "cls", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group (its smallest doc_id), in the columns of ``docs``.

    Rows of that doc_id with the same text are reduced to one; documents without a set, or without a doc_id and
    links, stay.
    """
    groups = grouped(docs, text, doc_id)
    gone = groups.where("n_shingles > 0 and component_id is not null and not (doc_id <=> component_id)")
    names = docs.columns
    out = docs.join(hinted(gone.select(F.col("doc_id").alias("gone_id")).where("gone_id is not null").distinct()),
                    F.col(doc_id) == F.col("gone_id"), "left_anti")
    # rows that repeat an id are few or none: only these are compared by text
    again = groups.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "cls").count().where("count > 1")
    again = written(again.select("doc_id").distinct(), "join-repeats")
    if again.isEmpty():
        return out.select(*names)
    again = hinted(again.select(F.col("doc_id").alias("gone_id")))
    same = F.col(doc_id) == F.col("gone_id")
    return out.join(again, same, "left_anti").select(*names).unionByName(
        out.join(again, same, "left_semi").select(*names).dropDuplicates([doc_id, text]))
