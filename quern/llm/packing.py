"""Packing of token sequences by linear grouping.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most `capacity` rows,
whatever the corpus) goes to the driver, which plans sequences:

1. Large lengths, in descending order, fall into groups of equal cardinality; each is rounded up to its group's
   largest. With so few sizes, the fractional configuration programme is solved by column generation, and whole
   multiples of its configurations are used.
2. Actual lengths take the places of the rounded ones; the last of a sequence is the one that best fits what the
   rounding has left.
3. What is left, small lengths above all, goes by best fit in descending order into the rooms that remain.

The plan is a list of intervals (length, first rank, last rank, first sequence, offset). Pieces get their rank among
those of equal length in two steps, salted by hash into as many parts as the table's size asks for, and find their interval in a broadcast join; its size follows from
the capacity and the number of groups, not from the corpus.

Defined results: null text is empty and has only the end token. Repeated rows each get a place. Ties in length go by
(doc_id, piece, checksum). An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import staged

CAPACITY = 2048
#: A length above capacity / LARGE counts as large; GROUPS groups of large lengths.
LARGE, GROUPS = 10, 32
#: Pieces of one length and salt that are ranked in one task, on average: the number of salts follows from it.
RANKED_TOGETHER = 50_000
#: In an order of positions, so many bits of neighbours (65,536 positions) are ranked in one task.
NEIGHBOURS = 16
#: Pieces of an order that are packed among themselves, at least, and how many such windows there are at most.
IN_WINDOW, MOST_WINDOWS = 20_000, 16
#: Words whose ids a worker remembers; beyond it, it starts anew. Longer words are not remembered.
REMEMBERED, LONGEST_REMEMBERED = 1_200_000, 256

#: Texts of these characters only are split here; all others go to the library whole.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-įı-ňŊ-ž]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\\sa-zß-öø-ž0-9]+")


class WordIds(dict):
    """The ids, as little-endian bytes, of words between which the tokenizer never merges."""

    def __init__(self, tokenizer, end_of_word: str):
        super().__init__()
        self.tokenizer, self.most = tokenizer, REMEMBERED
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(end_of_word)]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, many in a text; each ends at a piece with the end-of-word mark."""
        texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.asarray(x.ids, "<u4") for x in found])
        cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(cuts) != len(words):
            raise ValueError("words and ends of words differ in number")
        data, starts = ids.tobytes(), [0, *cuts[:-1].tolist()]
        self.update(zip(words, [data[a:b] for a, b in zip(starts, cuts.tolist())]))

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        plain = [None if "<|" in t or not _PLAIN.fullmatch(t) else _SPLIT.findall(t.lower()) for t in texts]
        if len(self) >= self.most:
            self.clear()
        if unknown := set().union(*filter(None, plain)).difference(self):
            self.learn(list(unknown))
        get = self.__getitem__
        found = [self.whole(t).tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, plain)]
        for word in unknown:
            if len(word) > LONGEST_REMEMBERED:
                del self[word]
        return found


_loaded: dict[str, WordIds] = {}


def load(path: str, end_of_word: str = "</w>") -> WordIds:
    """The tokenizer of a vocabulary file, once a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = WordIds(Tokenizer.from_file(path), end_of_word)
    return _loaded[path]


def _portions(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes each, a row at least."""
    ends = np.cumsum(np.asarray(pa.compute.binary_length(batch.column("text"))))
    start = 0
    while start < len(ends):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _pieces(path: str, capacity: int, end_id: int, remembered: int, forget: bool, placed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([*_PIECES, pa.field("position", pa.int64())] if placed else _PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = load(path), np.asarray([end_id], "<u4").tobytes()
        words.most = remembered
        for batch in batches:
            rows = []
            for part in _portions(batch):
                docs, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                places = [(v,) for v in part.column("position").to_pylist()] if placed else [()] * part.num_rows
                for doc, place, ids in zip(docs, places, words.of(texts)):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(cut) // 4, zlib.crc32(cut), *place))
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        if forget:
            _loaded.pop(path, None)

    return run


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, remembered: int = REMEMBERED, forget: bool = False, position: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every document: its ids, then end_id. position: a column of
    whole numbers, the document's place in an order, which its pieces carry.

    remembered words a worker bound its memory (about 200 bytes each); fewer cost more calls of the tokenizer. With
    forget, a worker lets go of the tokenizer and its words at the end of a task."""
    place = [] if position is None else [F.col(position).cast("long").alias("position")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *place)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", position long" * len(place)
    return rows.mapInArrow(_pieces(path, capacity, end_id, remembered, forget, bool(place)), schema)


def _best_configuration(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of sizes within capacity whose values sum highest (unbounded knapsack)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        totals = np.where(sizes <= room, best[np.maximum(room - sizes, 0)] + values, -1.0)
        k = int(totals.argmax())
        if totals[k] > best[room - 1] + 1e-12:
            best[room], took[room] = totals[k], k
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= int(sizes[took[room]])
    return float(best[capacity]), counts


def configurations(sizes: list[int], demands: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations with fractional multiplicities that cover the demands in as few bins as possible."""
    width, need = np.asarray(sizes), np.asarray(demands, float)
    basis = np.diag((capacity // width).astype(float))
    for _ in range(40 * len(sizes)):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = _best_configuration(prices, width, capacity)
        if value <= 1 + 1e-9:
            break
        amount, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-12, amount / np.where(step > 1e-12, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return list(zip(basis.T.copy(), np.linalg.solve(basis, need)))


class Rooms:
    """Sequences begun, by the room that they have left: runs of (first sequence, how many)."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.intervals: list[tuple[int, int, int, int, int]] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.left: list[int] = []

    def open(self, number: int) -> int:
        first, self.next = self.next, self.next + number
        return first

    def place(self, length: int, rank: int, number: int, first: int, offset: int) -> None:
        self.intervals.append((length, rank, rank + number, first, offset))

    def keep(self, room: int, first: int, number: int) -> None:
        if room and number:
            if not self.runs[room]:
                insort(self.left, room)
            self.runs[room].append((first, number))

    def best_fit(self, length: int, rank: int, number: int) -> None:
        while number:
            at = bisect_left(self.left, length)
            if at < len(self.left):
                room = self.left[at]
                first, held = self.runs[room].pop()
                used = min(held, number)
                if held > used:
                    self.runs[room].append((first + used, held - used))
                elif not self.runs[room]:
                    del self.left[at]
                self.place(length, rank, used, first, self.capacity - room)
                self.keep(room - length, first, used)
            else:
                each = min(self.capacity // length, number)
                used = number // each
                first = self.open(used)
                for k in range(each):
                    self.place(length, rank + k * used, used, first, k * length)
                self.keep(self.capacity - each * length, first, used)
                used *= each
            rank, number = rank + used, number - used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, end rank, first sequence, offset) that place every piece of the histogram."""
    rooms, ranks, held = Rooms(capacity), dict.fromkeys(histogram, 0), dict(histogram)
    if n := held.pop(capacity, 0):
        rooms.place(capacity, 0, n, rooms.open(n), 0)
    large = sorted(n for n in held if n > capacity // LARGE)
    each = -(-sum(held[n] for n in large) // groups)
    bounds: list[list[int]] = []  # of groups: smallest length, largest length, pieces
    for length in reversed(large):
        if not bounds or bounds[-1][2] >= each:
            bounds.append([length, length, 0])
        bounds[-1][0] = length
        bounds[-1][2] += held[length]
    solved = configurations([b[1] for b in bounds], [b[2] for b in bounds], capacity) if bounds else []
    for column, amount in sorted(solved, key=lambda x: -x[1]):
        slots = [bounds[g] for g, k in enumerate(column) for _ in range(int(round(k)))]
        number = int(amount + 1e-9)
        while number and (lengths := _substitutes(slots, large, held, capacity)):
            used = min(number, *(held[n] // lengths.count(n) for n in set(lengths)))
            first, offset = rooms.open(used), 0
            for length in lengths:
                rooms.place(length, ranks[length], used, first, offset)
                ranks[length] += used
                held[length] -= used
                offset += length
            rooms.keep(capacity - offset, first, used)
            for length in set(lengths):
                if not held[length]:
                    large.remove(length)
            number -= used
    for length in sorted(held, reverse=True):
        rooms.best_fit(length, ranks[length], held[length])
    return rooms.intervals


def _substitutes(slots: list[list[int]], large: list[int], held: dict[int, int], capacity: int) -> list[int]:
    """Actual lengths for the places of a configuration: the largest of each group, and for the last the best fit."""
    lengths: list[int] = []
    room = capacity
    for k, (low, high, _) in enumerate(slots):
        if k == len(slots) - 1:
            low, high = 0, room
        at = bisect_right(large, min(high, room)) - 1
        while at >= 0 and held[large[at]] <= lengths.count(large[at]):
            at -= 1
        if at < 0 or large[at] < low:
            return []
        lengths.append(large[at])
        room -= large[at]
    return lengths


def _window(pieces: DataFrame, number: int) -> Column:
    """The part of the order, of `number` about equal ones, that a piece's position falls in."""
    bounds = sorted(set(pieces.approxQuantile("position", [k / number for k in range(1, number)], 0.001))) if number > 1 else []
    return sum(((F.col("position") > F.lit(b)).cast("int") for b in bounds), F.lit(0))


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, windows: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Where pieces carry a position, they are packed by windows of its order (by default one for each IN_WINDOW pieces, MOST_WINDOWS
    at most), those of one length in a window are dealt to sequences in order, a sequence's position is the mean of its
    pieces', and the rows come sorted by it, sequence by sequence; only pieces are sorted, no texts."""
    pieces = staged(pieces)
    ordered, number = "position" in pieces.columns, pieces.count()
    salts = -(-number // RANKED_TOGETHER) or 1
    windows = windows or min(MOST_WINDOWS, number // IN_WINDOW + 1)
    # in order, neighbours share a salt, and salts follow each other
    salt = F.shiftright(F.coalesce("position", F.lit(0)), NEIGHBOURS) if ordered else F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts))
    salted = pieces.withColumn("_salt", salt).withColumn("_window", _window(pieces, windows) if ordered else F.lit(0))
    counts = salted.groupBy("_window", "length", "_salt").agg(F.count("*").alias("_n"))
    histograms: dict[int, dict[int, int]] = defaultdict(dict)
    for r in counts.groupBy("_window", "length").agg(F.sum("_n").alias("n")).collect():  # at most `capacity` rows a window
        histograms[r["_window"]][r["length"]] = r["n"]
    spots, opened = [], 0
    for window in sorted(histograms):
        intervals = plan(histograms[window], capacity, groups)
        spots += [(window, length, first, end, opened + sequence, offset) for length, first, end, sequence, offset in intervals]
        opened += max(sequence + end - first for _, first, end, sequence, _ in intervals)
    spots = pieces.sparkSession.createDataFrame(spots, "_w long, _length long, _first long, _end long, _sequence long, offset long")
    earlier = Window.partitionBy("_window", "length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    named = (F.col("_window").alias("_v"), F.col("length").alias("_l"), F.col("_salt").alias("_s"))
    bases = counts.select(*named, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_window", "length", "_salt").orderBy(*(["position"] if ordered else []), "doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(inside) - 1)
    same = (F.col("_window") == F.col("_v")) & (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))
    ranked = ranked.join(bases, same).withColumn("_rank", F.col("_base") + F.col("_row"))
    at = (F.col("_window") == F.col("_w")) & (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    placed = ranked.join(F.broadcast(spots), at)
    sequence = F.col("_sequence") + F.col("_rank") - F.col("_first")
    placed = placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", *(["position"] if ordered else []))
    if not ordered:
        return placed
    placed = staged(placed)
    means = placed.groupBy(F.col("sequence_id").alias("_s")).agg(F.avg("position").alias("_mean"))
    met = placed.join(means, F.col("sequence_id") == F.col("_s")).withColumn("position", F.col("_mean")).drop("_s", "_mean")
    return met.orderBy("position", "sequence_id", "offset")
