"""SentencePiece encoding and decoding over a lattice of words.

A model with byte-pair scores is not the best path of a lattice (the largest sum of scores gives other pieces),
so the fold is the model's own rule instead of Viterbi: merge the adjacent pair with the best score, leftmost
first, until no pair is a piece. Everything before is the lattice: texts are cut into words where no piece can
reach across, words are made distinct within a task, all their substrings up to the longest piece are looked up in
the piece table by hash, and the edges stand grouped by word (start x length). Each task does this with numpy on
its Arrow batches. It is not a relational lattice: there is no Spark explode, join, grouping by word or higher-order
aggregate. Joining the pieces of distinct words back would move a row for every word of every text through a
shuffle, several times the input.

Defined results: null and empty texts have no pieces; characters without a piece become byte pieces; the mark
U+2581 in a text is a blank, as in the model; texts of any length are encoded whole; repeated rows give equal rows;
further columns are kept, except that the new one replaces a column of its name; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import without
from .words import lean, mix, pieces

BLANK = "▁"
MAX_PIECES = 1_000_000  # a vocabulary is broadcast; a larger file is refused, not cut
LONG_WORD = 48  # longer words are merged one by one, with a heap
NONE = np.int32(2**31 - 1)
CHUNK = 1 << 20
KNOWN_WORDS = 500_000
SLOTS = 1 << 22


class Vocabulary(NamedTuple):
    """What is shipped to tasks: pieces by id, which are ordinary, their scores, and the ids of the byte pieces."""
    names: list[str]
    ordinary: list[bool]
    scores: list[float]
    bytes_at: list[int]


def load(path: str) -> Vocabulary:
    """Read a SentencePiece model file (on the driver)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError(f"{path}: {n} pieces; at most {MAX_PIECES} are broadcast")
    names = [model.id_to_piece(i) for i in range(n)]
    ordinary = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(n)]
    return Vocabulary(names, ordinary, [model.get_score(i) for i in range(n)],
                      [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def key_of(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


FACTOR = np.uint64(xxhash.xxh64_intdigest(b"factor") | 1)


def pair_slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left.astype(np.uint32) * np.uint32(2654435761) + right.astype(np.uint32) * np.uint32(40503))
            >> np.uint32(3)) % np.uint32(SLOTS)


class Known:
    """Words a task has met and their piece ids; starts anew when it holds too many."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.base = self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def add(self, h: np.ndarray, base: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        if len(self.hashes) + len(h) > KNOWN_WORDS:
            self.__init__()
            return
        h, base, count = (np.concatenate(x) for x in ((self.hashes, h), (self.base, base), (self.count, count)))
        order = np.argsort(h, kind="stable")
        self.hashes, self.base, self.count, self.flat = h[order], base[order], count[order], flat


class Encoder:
    """The piece table as arrays, and the encoding of many texts at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        chosen = [i for i, ok in enumerate(vocabulary.ordinary) if ok]
        codes = [np.frombuffer(vocabulary.names[i].encode("utf-32-le"), np.uint32) for i in chosen]
        self.longest = max(map(len, codes), default=1)
        # rank 0 is the best score; equal scores share a rank, so that the leftmost pair wins among them
        scores = -np.array([vocabulary.scores[i] for i in chosen])
        rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        hashes = self.hashes_of(codes)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(chosen, np.int32)[order]
        self.rank_at = np.full(len(vocabulary.names) + 1, NONE, np.int32)  # by id; the last for "no piece"
        self.rank_at[chosen] = rank
        # a slot table in front of the sorted hashes: most substrings are no piece and leave here
        self.maybe = np.zeros(SLOTS, bool)
        self.maybe[hashes % np.uint64(SLOTS)] = True
        # pairs of characters inside a piece; a false yes only makes a word longer
        self.joins = np.zeros(SLOTS, bool)
        for c in codes:
            if len(c) > 1:
                self.joins[pair_slot(c[:-1], c[1:])] = True
        self.by_name = {vocabulary.names[i]: i for i in chosen}
        self.rank_of = dict(zip((vocabulary.names[i] for i in chosen), rank.tolist()))
        self.byte_ids = np.array(vocabulary.bytes_at, np.int32)

    @staticmethod
    def hashes_of(codes: list[np.ndarray]) -> np.ndarray:
        """The hash of each piece; pieces of one length together."""
        size, out = np.array([len(c) for c in codes]), np.zeros(len(codes), np.uint64)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            keys, h = key_of(np.stack([codes[i] for i in at])), np.zeros(len(at), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = h * FACTOR + keys[:, k]
            out[at] = mix(h)
        return out

    def lattice(self, codes: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Id of the piece that starts at a place with a length, or -1, for all places; ``stop`` ends the word."""
        n = len(codes)
        ids = np.full((self.longest, n), -1, np.int32)
        keys, place = key_of(codes), np.arange(n)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, self.longest + 1):
                inside = place + size <= stop[place]
                place, h = place[inside], h[inside] * FACTOR + keys[place[inside] + size - 1]
                if not len(place):
                    break
                found = mix(h)
                hit = np.flatnonzero(self.maybe[found % np.uint64(SLOTS)])
                at = np.minimum(np.searchsorted(self.hashes, found[hit]), len(self.hashes) - 1)
                true = self.hashes[at] == found[hit]
                hit, at = hit[true], at[true]
                ids[size - 1, place[hit]] = self.ids[at]
        return ids

    def merged(self, start: np.ndarray, stop: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where the symbols of all words begin, after merging; one pair a word and round."""
        word_of = np.repeat(np.arange(len(start)), stop - start)
        symbol = np.arange(len(codes))
        begins = np.ones(len(codes), bool)
        word = word_of
        while len(symbol):
            after = np.append(symbol[1:], len(codes))
            third = np.append(symbol[2:], [len(codes)] * 2)[:len(symbol)]
            limit = stop[word]
            third = np.minimum(third, limit)
            size = third - symbol
            pair = (after < limit) & (size <= self.longest)
            score = np.full(len(symbol), NONE, np.int32)
            score[pair] = self.rank_at[ids[size[pair] - 1, symbol[pair]]]
            edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(score, edge)
            times = np.diff(np.append(edge, len(symbol)))
            best = np.flatnonzero((score == np.repeat(least, times)) & (score != NONE))
            if not len(best):
                break
            best = best[np.append(True, word[best][1:] != word[best][:-1])]  # the leftmost of a word
            begins[after[best]] = False
            alive = np.repeat(least != NONE, times) & begins[symbol]
            symbol, word = symbol[alive], word[alive]
        return begins

    def merge_long(self, word: str) -> list[int]:
        """The same rule for one long word, with a heap of pairs; returns where symbols begin."""
        n = len(word)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a < 0 or b >= n or end[b] - a > self.longest:
                return
            r = self.rank_of.get(word[a:end[b]])
            if r is not None:
                heapq.heappush(heap, (r, a, b, end[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        alive = [True] * n
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if not (alive[a] and b < n and alive[b] and after[a] == b and end[b] == stop and end[a] == b):
                continue
            alive[b], end[a], after[a] = False, stop, after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [i for i in range(n) if alive[i]]

    def word_pieces(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each); words are ranges that follow one another."""
        long_word = stop - start > LONG_WORD
        limit = np.repeat(stop, stop - start)
        ids = self.lattice(codes, limit)
        plain = ids
        if long_word.any():
            plain = np.where(np.repeat(long_word, stop - start), np.int32(-1), ids)
        begins = self.merged(start, stop, codes, plain)
        for w in np.flatnonzero(long_word).tolist():
            a, b = int(start[w]), int(stop[w])
            begins[a:b] = False
            begins[a + np.array(self.merge_long(codes[a:b].tobytes().decode("utf-32-le")))] = True
        symbol = np.flatnonzero(begins)
        size = np.diff(np.append(symbol, len(codes)))
        piece = ids[size - 1, symbol]
        times = np.ones(len(symbol), np.int64)
        unknown = np.flatnonzero(piece < 0)
        flat = piece
        if len(unknown):
            spelled = [self.byte_ids[list(chr(c).encode())] for c in codes[symbol[unknown]].tolist()]
            times[unknown] = [len(x) for x in spelled]
            ends = np.cumsum(times)
            flat = np.repeat(piece, times)
            for k, x in zip((ends - times)[unknown].tolist(), spelled):
                flat[k:k + len(x)] = x
        ends = np.append(0, np.cumsum(times))
        first = ends[np.searchsorted(symbol, start)]
        return flat, np.diff(np.append(first, len(flat)))

    def encode(self, texts: list[str], known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        texts = [x.replace(" ", BLANK) for x in texts]
        codes = np.frombuffer("".join(BLANK + x for x in texts if x).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(x) + 1 if x else 0 for x in texts], dtype=np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.joins[pair_slot(codes[:-1], codes[1:])]
        first = np.cumsum(sizes) - sizes
        cut[first[sizes > 0]] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(codes))
        length = stop - start
        # the distinct words, by a hash over their characters
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()), FACTOR, np.uint64)), dtype=np.uint64)
            offset = np.arange(len(codes)) - np.repeat(start, length)
            h = mix(np.add.reduceat(key_of(codes) * powers[offset], start) + length.astype(np.uint64))
        h, sample, word = np.unique(h, return_index=True, return_inverse=True)
        known = known if known is not None else Known()
        at, old = known.find(h)
        new = np.flatnonzero(~old)
        count, base = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        count[old], base[old] = known.count[at[old]], known.base[at[old]]
        found = known.flat
        if len(new):
            size = length[sample[new]]
            ends = np.cumsum(size)
            take = np.arange(ends[-1]) + np.repeat(start[sample[new]] - (ends - size), size)
            more, count[new] = self.word_pieces(codes[take], ends - size, ends)
            base[new] = len(found) + np.cumsum(count[new]) - count[new]
            found = np.concatenate([found, more])
            known.add(h[new], base[new], count[new], found)
        times = count[word]
        ends = np.cumsum(times)
        flat = found[np.arange(ends[-1]) + np.repeat(base[word] - (ends - times), times)]
        bounds = np.append(0, ends)
        place = np.searchsorted(start, np.append(first, len(codes)))
        return flat, np.diff(bounds[place])


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        spelled = [n.encode() if ok else b"" for n, ok in zip(vocabulary.names, vocabulary.ordinary)]
        for b, i in enumerate(vocabulary.bytes_at):
            spelled[i] = bytes([b])
        self.size = np.array([len(x) for x in spelled], dtype=np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids; byte pieces that make no character show as U+FFFD."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return ""
        body = self.flat[np.arange(ends[-1]) + np.repeat(self.base[ids] - (ends - size), size)].tobytes()
        return body.decode("utf-8", "replace").replace(BLANK, " ").removeprefix(" ")


def ship(spark: SparkSession, path: str):
    """Broadcast the coder of a model file; its size is that of the vocabulary, which :func:`load` bounds."""
    vocabulary = load(path)
    return spark.sparkContext.broadcast((Encoder(vocabulary), Decoder(vocabulary)))


def encode(docs: DataFrame, shipped, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each text, in place of a column called ``ids``; nothing is shuffled."""
    docs = without(docs, [ids], keep=[text])
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + [f"`{ids}` array<int>"])

    def task(batches: Iterator[pa.RecordBatch]):
        encoder, known = shipped.value[0], Known()
        for batch in pieces(batches, text, CHUNK):
            flat, sizes = encoder.encode([x or "" for x in batch.column(text).to_pylist()], known)
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, ids])

    return docs.mapInArrow(lean(task), schema)


def decode(encoded: DataFrame, shipped, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the ids spell, in place of a column called ``text``."""
    encoded = without(encoded, [text], keep=[ids])
    schema = ", ".join([f"`{n}` {t}" for n, t in encoded.dtypes] + [f"`{text}` string"])

    def task(batches: Iterator[pa.RecordBatch]):
        decoder = shipped.value[1]
        for batch in batches:
            column = batch.column(ids)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [decoder.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return encoded.mapInArrow(lean(task), schema)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_equal) of every document."""
    shipped = ship(docs.sparkSession, path)
    both = decode(encode(docs.select("doc_id", F.col(text).alias("text")), shipped), shipped)
    plain = F.translate(F.coalesce("text", F.lit("")), BLANK, " ")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids",
                       (F.col("decoded") == plain).alias("decoded_equal"))
