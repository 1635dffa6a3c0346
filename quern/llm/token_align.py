"""Alignment of the tokens of two tokenizers by pointer jumping.

Both tokenizers cut the bytes of space+text. Every token points to the farthest-right token of the other side that shares
a byte with it; a token of the first side that ends where one of the second ends points to itself. Doubling (each token
takes its successor's successor, for all texts of a block at once) leads every token to the last one of its group, which
labels the group. All pairs of a group's tokens are links.

How many documents hold an id pair linked is counted over the whole table: each block of about BLOCK bytes of text, aligned in parts, carries
the list of its distinct pairs with their documents, those lists are summed by pair, and the sums go back to the blocks
that hold the pair. So what is exchanged is a block's distinct pairs and, once, the documents' places in their block's
list; no document's pairs meet another's, and a pair that every document holds is one row a block.

Defined results: a text that is null or empty, or whose tokens' bytes of either side differ from space+text (as where the
text holds U+2581 itself), has no tokens: zeros, and an empty digest. Repeated rows are rows of their own, and each counts
as a document. An empty table gives no rows. Other columns than `keep` are dropped. A text is held whole in its task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import small_batches, staged

#: Bytes of text whose pairs share one list, and of those that are aligned at once: arrays over a part's tokens take about
#: a hundred bytes for each of its bytes.
BLOCK, PART = 4_000_000, 400_000
#: Units of text whose ids a worker remembers, at most; longer units are not remembered.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64
#: A group with more links than this is counted by its distinct ids, not link by link.
LINKS_AT_ONCE = 4096
#: Texts of more characters go to the library of the vocabulary file itself instead of the faster one of equal results.
LONG_TEXT = 200_000


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: visible Latin-1 ones stand for themselves, the others
    for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteLevel:
    """The first side: ids of a byte-level vocabulary file, and the bytes of each id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        alphabet = byte_alphabet()
        self.bytes = {i: bytes(alphabet[c] for c in piece) for piece, i in model["vocab"].items() if piece not in special}
        # ids of such a vocabulary are its merge order
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

        self.sizes = _sizes(self.bytes)

    def ids(self, text: str) -> np.ndarray | None:
        """Ids of space+text; None where their bytes differ from it."""
        whole = " " + text
        if len(text) > LONG_TEXT:
            ids = self.library.encode(whole, add_special_tokens=False).ids
            return np.array(ids, np.int64) if b"".join(self.bytes[i] for i in ids) == whole.encode() else None
        ids = self.fast.encode_ordinary(whole)
        return np.array(ids, np.int64) if self.fast.decode_bytes(ids) == whole.encode() else None


def _sizes(pieces: dict[int, bytes]) -> np.ndarray:
    """Bytes of each id."""
    out = np.zeros(max(pieces) + 1, np.int64)
    out[list(pieces)] = [len(b) for b in pieces.values()]
    return out


class Units(dict):
    """Ids of units of text as bytes of 32-bit numbers, filled on demand. A unit whose pieces differ from it has the id -1
    among its own. Half of what is remembered is `older`: those units of it that are not met again are forgotten.

    A unit is a line break, or a run of other characters that holds a space only where it begins: no piece holds a line
    break, or a space after another character, so units are cut into pieces on their own."""

    FORM = re.compile(" *[^ \n]+| +|\n")

    def __init__(self, model, pieces: dict[int, bytes]):
        super().__init__()
        self.encode, self.pieces, self.older = model.encode, pieces, {}

    def __missing__(self, unit: str) -> bytes:
        if (known := self.older.get(unit)) is not None:
            return self.kept(unit, known)
        ids = self.encode("\n" + unit, num_threads=1)[2:]  # without the space that the library puts first, and the break
        if b"".join(self.pieces[i] for i in ids) != unit.encode():
            ids = [-1, *ids]
        return self.kept(unit, np.array(ids, np.int32).tobytes())

    def kept(self, unit: str, ids: bytes) -> bytes:
        if len(unit) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class Pieces:
    """The second side: ids of a piece vocabulary file, which itself puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {i: bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)}
        self.sizes = _sizes(self.bytes)
        by_unit = not any("▁" in p.lstrip("▁") or "\n" in p for p in names) and len(self.model.encode("\n")) == 2
        self.units = Units(self.model, self.bytes) if by_unit else None

    def ids(self, text: str) -> np.ndarray | None:
        """Ids of the text; None where their bytes differ from space+text."""
        if self.units is None or "▁" in text:
            ids = self.model.encode(text, num_threads=1)
            return np.array(ids, np.int64) if b"".join(self.bytes[i] for i in ids) == b" " + text.encode() else None
        ids = np.frombuffer(b"".join(map(self.units.__getitem__, Units.FORM.findall(" " + text))), np.int32).astype(np.int64)
        return None if ids.min() < 0 else ids


_loaded: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def load(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """Both sides, once a worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = ByteLevel(a_path), Pieces(b_path)
    return _loaded[a_path, b_path]


def jump(successor: np.ndarray) -> np.ndarray:
    """Where following the successors ends, by doubling."""
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor
        successor = further


def group_numbers(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups, from 0 in order, of the tokens of both sides, given where each token ends; both sides end at the same byte."""
    n = len(a_end)
    met_b, met_a = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    last = b_end[met_b] == a_end if n else np.zeros(0, bool)
    terminal = jump(np.concatenate([np.where(last, np.arange(n), n + met_b), met_a]))
    number = np.cumsum(last) - 1
    return number[terminal[:n]], number[terminal[n:]]


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. most as rows of bytes with room for one separator, and which of them to write."""
    width = len(str(most))
    powers = 10 ** np.arange(width - 1, -1, -1)
    digits = (np.arange(most + 1)[:, None] // powers) % 10
    shown = np.arange(most + 1)[:, None] >= powers
    shown[:, -1] = True
    return np.hstack([digits + ord("0"), np.zeros((most + 1, 1), int)]).astype(np.uint8), np.hstack([shown, np.ones((most + 1, 1), bool)])


def _written(ids: np.ndarray, separators: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Ids in decimal, each with its separator; also where each ends."""
    digits, shown = _digits(int(ids.max()))
    rows, keep = digits[ids], shown[ids]
    rows[:, -1] = separators
    return rows[keep].tobytes(), np.cumsum(keep.sum(axis=1))


def _spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times, for each i."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


class Block:
    """The alignment of some texts at once: everything by array operations over the tokens of all of them."""

    def __init__(self, texts: list[str | None], a: ByteLevel, b: Pieces):
        self.n = len(texts)
        a_ids, b_ids = [], []
        self.n_a, self.n_b = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for i, text in enumerate(texts):
            if text and (own_a := a.ids(text)) is not None and (own_b := b.ids(text)) is not None:
                a_ids.append(own_a)
                b_ids.append(own_b)
                self.n_a[i], self.n_b[i] = len(own_a), len(own_b)
        none = np.zeros(0, np.int64)
        self.a_ids, self.b_ids = np.concatenate([none, *a_ids]), np.concatenate([none, *b_ids])
        self.group_a, self.group_b = group_numbers(np.cumsum(a.sizes[self.a_ids]), np.cumsum(b.sizes[self.b_ids]))
        self.of_a, self.of_b = np.bincount(self.group_a), np.bincount(self.group_b)  # tokens of each group
        self.first_a, self.first_b = np.cumsum(self.of_a) - self.of_a, np.cumsum(self.of_b) - self.of_b
        self.text_of = np.repeat(np.arange(self.n), self.n_a)[self.first_a] if len(self.of_a) else np.zeros(0, np.int64)
        self.n_groups = np.bincount(self.text_of, minlength=self.n)
        self.links = self.of_a * self.of_b
        self.n_links = np.zeros(self.n, np.int64)
        np.add.at(self.n_links, self.text_of, self.links)

    def digests(self) -> list[str]:
        """SHA-256 of the groups of each text as `a1,a2|b1;a3|b2,b3`."""
        if not len(self.a_ids):
            return [""] * self.n
        of = np.empty(2 * len(self.of_a), np.int64)  # runs of tokens in the order written: a group's first side, its second side
        of[0::2], of[1::2] = self.of_a, self.of_b
        starts = np.empty_like(of)
        starts[0::2], starts[1::2] = self.first_a, len(self.a_ids) + self.first_b
        ids = np.concatenate([self.a_ids, self.b_ids])[_spread(of, starts)]
        separators = np.full(len(ids), ord(","), np.uint8)
        ends = np.cumsum(of) - 1
        separators[ends[0::2]], separators[ends[1::2]] = ord("|"), ord(";")
        data, places = _written(ids, separators)
        out, start = [], 0
        for last in np.cumsum(self.n_a + self.n_b):
            end = int(places[last - 1]) if last else 0
            out.append(hashlib.sha256(data[start : end - 1]).hexdigest() if end > start else "")
            start = max(start, end)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links) of the distinct id pairs of each text, by text and pair; a pair is a * 2**20 + b."""
        small = self.links <= LINKS_AT_ONCE
        mine = small[self.group_a]
        times = self.of_b[self.group_a[mine]]
        keys = np.repeat((self.text_of[self.group_a[mine]] << 40) | (self.a_ids[mine] << 20), times)
        keys |= self.b_ids[_spread(times, self.first_b[self.group_a[mine]])]
        keys, weights = np.unique(keys, return_counts=True)
        parts, counts = [keys], [weights]
        for g in np.flatnonzero(~small):
            a, of_a = np.unique(self.a_ids[self.first_a[g] : self.first_a[g] + self.of_a[g]], return_counts=True)
            b, of_b = np.unique(self.b_ids[self.first_b[g] : self.first_b[g] + self.of_b[g]], return_counts=True)
            parts.append(((self.text_of[g] << 40) | (a[:, None] << 20) | b).ravel())
            counts.append((of_a[:, None] * of_b).ravel())
        if len(parts) > 1:
            keys, at = np.unique(np.concatenate(parts), return_inverse=True)
            weights = np.zeros(len(keys), np.int64)
            np.add.at(weights, at, np.concatenate(counts))
        return keys >> 40, keys & ((1 << 40) - 1), weights


def _chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many bytes of text, or of one row."""
    for batch in batches:
        sizes = batch.column("_text").cast(pa.large_binary())
        ends = np.cumsum([len(s.as_buffer()) if s.is_valid else 0 for s in sizes])
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


_OWN = "_block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _at array<int>, _times array<long>, _pairs array<long>, _docs array<long>"


def _aligning(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load(a_path, b_path)
        part = TaskContext.get().partitionId()
        for k, chunk in enumerate(_chunks(batches, BLOCK)):
            sizes, digests, pairs = [], [], []
            for piece in _chunks([chunk], PART):
                block = Block(piece.column("_text").to_pylist(), a, b)
                text, pair, times = block.pairs()
                sizes.append((block.n_a, block.n_b, block.n_groups, block.n_links))
                pairs.append((text + len(digests), pair, times))
                digests += block.digests()
                del block
            text, pair, times = map(np.concatenate, zip(*pairs))
            listed, at = np.unique(pair, return_inverse=True)
            n = len(digests)
            offsets = np.searchsorted(text, np.arange(n + 1))
            held = np.array([0] + [len(listed)] * n)  # the block's list stands in its first row
            lists = lambda ends, values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
            own = [
                pa.array(np.full(n, (part << 32) + k), pa.int64()), *(pa.array(np.concatenate(v), pa.int64()) for v in zip(*sizes)),
                pa.array(digests, pa.string()), lists(offsets, at, pa.int32()), lists(offsets, times, pa.int64()), lists(held, listed, pa.int64()),
                lists(held, np.bincount(at, minlength=len(listed)), pa.int64()),
            ]
            kept = [name for name in chunk.schema.names if name != "_text"]
            yield pa.RecordBatch.from_arrays([*(chunk.column(n) for n in kept), *own], names=[*kept, *(c.split()[0] for c in _OWN.split(", "))])

    return run


def _kinds(df: DataFrame, names: tuple[str, ...]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)


def blocks(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The aligned rows, written: keep, sizes and digest, and each row's pairs as places in the list of its block."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    return staged(rows.mapInArrow(_aligning(a_path, b_path), _kinds(rows, keep) + _OWN))


def _listed(aligned: DataFrame) -> DataFrame:
    """(_block, at, pair, docs): the distinct pairs of each block and how many of its documents hold them."""
    both = F.arrays_zip(F.col("_pairs").alias("pair"), F.col("_docs").alias("docs"))
    return aligned.filter(F.size("_pairs") > 0).select("_block", F.posexplode(both).alias("at", "_p")).select("_block", "at", "_p.pair", "_p.docs")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n_docs, best of all linked id pairs: the documents that hold the pair linked, and whether no pair
    of the same first id is held by more."""
    totals = _listed(aligned).groupBy("pair").agg(F.sum("docs").alias("n_docs")).withColumn("a_id", F.shiftright("pair", 20).cast("int"))
    most = totals.groupBy("a_id").agg(F.max("n_docs").alias("_most"))  # at most a row for each id of the first vocabulary
    ids = totals.join(F.broadcast(most), "a_id").withColumn("b_id", F.col("pair").bitwiseAND((1 << 20) - 1).cast("int"))
    return ids.select("pair", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def _summed(names: list[str]):
    def run(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        """n_best and count_sum of the rows of one block, by the counts of its list."""
        order = counts.column("at").to_numpy()
        n_docs, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        n_docs[order], best[order] = counts.column("n_docs").to_numpy(), counts.column("best").to_numpy().astype(np.int64)
        at, times = docs.column("_at").combine_chunks(), docs.column("_times").combine_chunks()
        sizes = at.value_lengths().to_numpy()
        row, at, times = np.repeat(np.arange(len(sizes)), sizes), at.flatten().to_numpy(), times.flatten().to_numpy()
        sums = np.zeros((2, len(sizes)), np.int64)
        np.add.at(sums[0], row, times * best[at])
        np.add.at(sums[1], row, times * n_docs[at])
        return pa.table([*(docs.column(n) for n in names), pa.array(sums[0]), pa.array(sums[1])], names=[*names, "n_best", "count_sum"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of each row's whole text: tokens of both sides,
    groups, links, links whose pair is the most frequent of its first id, and documents that hold the pair, over links."""
    aligned = blocks(docs, a_path, b_path, text, keep)
    counts = pair_counts(aligned).select("pair", "n_docs", "best")
    found = _listed(aligned).select("_block", "at", "pair").join(counts, "pair").select(F.col("_block").alias("_list"), "at", "n_docs", "best")
    names = [*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = aligned.select("_block", *names, "_at", "_times")
    schema = _kinds(rows, tuple(names)) + "n_best long, count_sum long"
    return rows.groupBy("_block").cogroup(found.groupBy("_list")).applyInArrow(_summed(names), schema)


def groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, group (from 0), a_ids, b_ids: the groups themselves, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load(a_path, b_path)
        for chunk in _chunks(batches, PART):
            block = Block(chunk.column("_text").to_pylist(), a, b)
            names = [n for n in chunk.schema.names if n != "_text"]
            number = np.arange(len(block.text_of)) - (np.cumsum(block.n_groups) - block.n_groups)[block.text_of]
            lists = lambda of, ids: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(of)]), pa.int32()), pa.array(ids, pa.int32()))
            columns = [chunk.column(n).take(pa.array(block.text_of)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number, pa.int64()), lists(block.of_a, block.a_ids), lists(block.of_b, block.b_ids)], names=[*names, "group", "a_ids", "b_ids"])

    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(run, _kinds(rows, keep) + "group long, a_ids array<int>, b_ids array<int>")
