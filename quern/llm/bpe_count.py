"""Token counts by byte-pair merging with a heap and a linked list.

A unit of text starts as a list of symbols, one a character. A heap holds every adjacent pair whose joined piece is in
the vocabulary, keyed by the piece's rank and then by place; the best pair is popped and merged, its neighbours are
linked and pushed, and so on until no pair is left. The count is the initial symbols minus the merges: no identifiers
are made. A character that is not in the vocabulary counts its UTF-8 bytes and never merges (byte fallback).

No piece holds a space mark after another character, so units that begin with their spaces merge on their own, and a
worker keeps the counts of units that it has seen, in a memory of bounded size. Within a unit, two characters that
stand side by side in no piece are a boundary too.

Defined results: null text counts as the empty string, which has no tokens. The other columns pass unchanged, repeated
rows included; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # what stands for a space in pieces
#: Units whose counts a worker remembers; beyond it, it starts anew. Longer units are not remembered.
REMEMBERED, LONGEST_REMEMBERED = 1_000_000, 256


class MergeCounter(dict):
    """Counts of units, filled on demand: counter[unit] is the number of tokens of a unit."""

    def __init__(self, pieces: list[str], scores: list[float]):
        super().__init__()
        levels = {score: n for n, score in enumerate(sorted(set(scores), reverse=True))}
        self.ranks = {piece: levels[score] for piece, score in zip(pieces, scores)}
        self.single = {piece for piece in pieces if len(piece) == 1}
        self.beside = {piece[i : i + 2] for piece in pieces for i in range(len(piece) - 1)}
        self.parts: dict[str, int] = {}

    def __missing__(self, unit: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
            self.parts.clear()
        total, start = 0, 0
        beside, parts = self.beside, self.parts
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1 : i + 1] not in beside:
                part = unit[start:i]
                n = parts.get(part)
                if n is None:
                    n = self.merged(part)
                    if len(part) <= LONGEST_REMEMBERED:
                        parts[part] = n
                total += n
                start = i
        if len(unit) <= LONGEST_REMEMBERED:
            self[unit] = total
        return total

    def merged(self, text: str) -> int:
        """Initial symbols minus merges of a text that has no inner boundary."""
        if len(text) == 1:
            return 1 if text in self.single else len(text.encode())
        get, size = self.ranks.get, len(text)
        symbols: list[str | None] = list(text)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = [rank * size + i for i in range(size - 1) if (rank := get(text[i : i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            rank, i = divmod(heappop(heap), size)
            left, j = symbols[i], after[i]
            if left is None or j >= size or get(left + symbols[j]) != rank:
                continue  # one of the pair has been merged since
            joined = left + symbols[j]
            symbols[i], symbols[j] = joined, None
            merges += 1
            j = after[i] = after[j]
            if j < size:
                before[j] = i
                if (rank := get(joined + symbols[j])) is not None:
                    heappush(heap, rank * size + i)
            if (h := before[i]) >= 0 and (rank := get(symbols[h] + joined)) is not None:
                heappush(heap, rank * size + h)
        single = self.single
        return size - merges + sum(len(c.encode()) - 1 for c in text if c not in single)


_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def count_tokens(text: str, counter: MergeCounter) -> int:
    """Tokens of a text with the space mark put before it."""
    if not text:
        return 0
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return sum(map(counter.__getitem__, _UNIT.findall(MARK + text.replace(" ", MARK))))
    head, *rest = text.split(" ")
    get = counter.__getitem__
    return get(MARK + head) + sum(map(get, [MARK + word for word in rest]))


_loaded: dict[str, MergeCounter] = {}


def load(path: str) -> MergeCounter:
    """The merge counter of a vocabulary file, once a worker."""
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        _loaded[path] = MergeCounter([model.id_to_piece(i) for i in own], [model.get_score(i) for i in own])
    return _loaded[path]


def _counting(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            counts = [count_tokens(text.as_py(), counter) for text in batch.column("_text")]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_text"]
            names = [name for name in batch.schema.names if name != "_text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], names=[*names, "n_tokens"])

    return run


def bpe_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """keep columns with n_bytes, n_tokens and over_limit of each row's whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    counted = rows.mapInArrow(_counting(path), f"{schema}, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
