"""AVI motion-JPEG media columns.

`store` writes bytes as AVI files: samples of 8 bits are blocks of baseline grey JPEG frames, each block constant at its
sample's value, so that its DC coefficient (step 8) holds the sample exactly. The frames' Huffman table gives every
difference 15 bits with its magnitude, plus one bit to end the block. `clips` parses the RIFF index of any AVI file,
decodes its intra frames to one value a block (an eighth of the size), takes grey histograms, and cuts shots where the
histogram difference stands out from those before it; each shot is a timed row. With `whole` all coefficients are
dequantised and inverse-transformed instead, and histograms are of pixels.

Frames with other baseline tables, several components and restart markers decode too, symbol by symbol; frames of one
file may differ in size, and an empty one repeats the one before it. Of several streams, the first video stream counts.
OpenDML indexes and the old one are read; without an index the lists are walked, to any depth. A frame without Huffman
tables means the four standard ones. Of two fields in a chunk the first is decoded. A frame that states more blocks than
its bytes can hold, a progressive one or one of 12 bits can't be parsed.

Defined results: null bytes are empty, and empty bytes are stored as 64 zeros. A file that is null or can't be parsed
gives no clips; `read_back` raises on it. Equal bytes give equal files. Repeated rows each get theirs; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 32  # blocks in a row of a stored frame, and rows at most
FRAME_MICROS = 40_000
HISTOGRAM_BINS = 16
#: A cut is a difference above the mean of the WINDOW before it by SPREADS deviations, and above LEAST.
WINDOW, SPREADS, LEAST = 8, 2.5, 0.08
UNIT = 64
_DC_BITS = 15
_PLAIN_DC = ([0] * 6 + [1] * 9 + [0], list(range(8, -1, -1)))  # lengths 7 to 15: magnitudes 8 to 0
_PLAIN_AC = ([1] + [0] * 15, [0])  # only the end of a block


def _codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for length, number in enumerate(counts, 1):
        for _ in range(number):
            out.append((code, length, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _standard() -> dict[int, tuple[list[int], list[int]]]:
    """The four tables of frames that bring none. The symbols of the AC tables are those listed, then all others in order."""
    every = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]
    with_rest = lambda head: head + sorted(set(every) - set(head))
    return {kind: (counts, with_rest(head) if kind & 0x10 else list(range(12))) for kind, (counts, head) in _STANDARD.items()}


#: Fixed values of the standard: numbers of codes by length, and the symbols of the shorter AC codes.
_STANDARD = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], []),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], []),
    0x10: ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], list(bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"))),
    0x11: ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], list(bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"))),
}
#: Fixed value: places of coefficients in the order they are coded, by diagonals in turns.
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _list(name: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(chunks))


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


@lru_cache(64)
def _header(rows: int, columns: int) -> bytes:
    """All of a stored frame before its scan data."""
    steps = _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
    size = _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * columns, 1, 1, 0x11, 0))
    tables = b"".join(_segment(0xC4, bytes([kind, *counts, *symbols])) for kind, (counts, symbols) in ((0x00, _PLAIN_DC), (0x10, _PLAIN_AC)))
    return b"\xff\xd8" + steps + size + tables + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


@lru_cache(1)
def _plain_words() -> np.ndarray:
    """The 16 bits of each difference from -255 to 255."""
    codes = {symbol: (code, length) for code, length, symbol in _codes(*_PLAIN_DC)}
    words = np.zeros(511, ">u2")
    for diff in range(-255, 256):
        magnitude = abs(diff).bit_length()
        extra = diff if diff >= 0 else diff + (1 << magnitude) - 1
        words[diff + 255] = ((codes[magnitude][0] << magnitude) | extra) << 1
    return words


def encode(payload: bytes) -> bytes:
    """An AVI file that holds a payload of one byte or more."""
    columns = SIDE
    rows = max(1, min(SIDE, -(-len(payload) // columns)))
    number = -(-len(payload) // (rows * columns))
    samples = np.zeros(number * rows * columns, np.int16)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    samples = samples.reshape(number, -1)
    scans = _plain_words()[np.diff(samples, axis=1, prepend=np.int16(128)) + 255]
    head = _header(rows, columns)
    frames = [_chunk(b"00dc", head + scan.tobytes() + b"\xff\xd9") for scan in scans]
    width, height = 8 * columns, 8 * rows
    main = struct.pack("<14I", FRAME_MICROS, 0, 0, 0x10, number, 0, 1, len(frames[0]), width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MICROS, 1_000_000, 0, number, len(frames[0]), -1, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    index, at = [], 4
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame) - 8))
        at += len(frame)
    header = _list(b"hdrl", _chunk(b"avih", main), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", picture)))
    length = _list(b"INFO", _chunk(b"ISBJ", str(len(payload)).encode() + b"\0"))
    return _chunk(b"RIFF", b"AVI " + header + length + _list(b"movi", *frames) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, size) of the chunks of a stretch."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def _leaves(data: bytes, at: int, end: int, kept: bytes | None = None) -> Iterator[tuple[bytes, int, int]]:
    """The chunks of a stretch and of the lists in it, in order; lists of the kept kind are given whole."""
    open_lists = [_chunks(data, at, end)]
    ends = [end]
    while open_lists:
        found = next(open_lists[-1], None)
        if found is None:
            open_lists.pop()
            ends.pop()
            continue
        name, body, size = found
        if name == b"LIST" and data[body : body + 4] != kept:
            ends.append(min(ends[-1], body + size))
            open_lists.append(_chunks(data, body + 4, ends[-1]))
        else:
            yield found


class Avi:
    """What the RIFF lists and indexes of an AVI file say of its first video stream."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        self.data, self.micros, self.length = data, FRAME_MICROS, None
        self.streams: list[bytes] = []
        self.movies: list[tuple[int, int]] = []
        self.old_index, self.supers = b"", {}
        for name, body, size in _chunks(data, 0, len(data)):  # one of "AVI ", then those of "AVIX"
            if name == b"RIFF":
                self._list(body + 4, min(len(data), body + size))
        if not self.movies:
            raise ValueError("no movi list")
        number = self.streams.index(b"vids") if b"vids" in self.streams else 0
        self.names = {b"%02d" % number + kind for kind in (b"dc", b"db")}
        self.places = self._by_super(number) or self._by_old_index() or self._by_walk()

    def _list(self, at: int, end: int) -> None:
        data = self.data
        for name, body, size in _leaves(data, at, end, b"movi"):
            if name == b"LIST":
                self.movies.append((body, min(end, body + size)))
            elif name == b"avih":
                self.micros = struct.unpack_from("<I", data, body)[0]
            elif name == b"strh":
                self.streams.append(data[body : body + 4])
            elif name == b"indx":
                self.supers[len(self.streams) - 1] = (body, size)
            elif name == b"ISBJ":
                self.length = int(data[body : body + size].rstrip(b"\0"))
            elif name == b"idx1":
                self.old_index = data[body : body + size]

    def _by_super(self, number: int) -> list[tuple[int, int]]:
        """(first byte, size) of frames by the OpenDML index of a stream: a list of standard indexes or one itself."""
        if number not in self.supers:
            return []
        body, size = self.supers[number]
        parts = [body]
        if self.data[body + 3] == 0:  # an index of indexes
            used = min(struct.unpack_from("<I", self.data, body + 4)[0], (size - 24) // 16)
            parts = [struct.unpack_from("<Q", self.data, body + 24 + 16 * n)[0] + 8 for n in range(used)]
        found = []
        for part in parts:
            _, _, _, used, _, base, _ = struct.unpack_from("<HBBI4sQI", self.data, part)
            entries = (struct.unpack_from("<II", self.data, part + 24 + 8 * n) for n in range(used))
            found += [(base + at, size & 0x7FFFFFFF) for at, size in entries]
        return found

    def _by_old_index(self) -> list[tuple[int, int]]:
        entries = list(struct.iter_unpack("<4sIII", self.old_index[: len(self.old_index) // 16 * 16]))
        first = self.movies[0][0]
        base = 0 if entries and entries[0][2] >= first else first  # offsets are from the file's start or the list's
        known = [(base + at + 8, size) for name, _, at, size in entries if name in self.names]
        return known + self._by_walk(1) if known else []  # the old index knows the first list only

    def _by_walk(self, skip: int = 0) -> list[tuple[int, int]]:
        return [(body, size) for at, end in self.movies[skip:] for name, body, size in _leaves(self.data, at + 4, end) if name in self.names]


def parse(data: bytes) -> tuple[list[bytes], int, int | None]:
    """The JPEG frames of an AVI file's first video stream by its index, microseconds a frame, and the payload's length
    where it is stored. A frame without bytes stands for the one before it."""
    avi = Avi(data)
    return [data[at : at + size] for at, size in avi.places], avi.micros, avi.length


class Jpeg:
    """The segments of a baseline JPEG frame."""

    def __init__(self, data: bytes):
        self.steps, self.tables, self.parts, self.restart = {}, _standard(), [], 0
        self.whole_steps: dict[int, np.ndarray] = {}
        at = 2
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    own = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    self.steps[body[0] & 15], self.whole_steps[body[0] & 15] = int(own[0]), own
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    counts = list(body[1:17])
                    self.tables[body[0]] = (counts, list(body[17 : 17 + sum(counts)]))
                    body = body[17 + sum(counts) :]
            elif marker in (0xC0, 0xC1):
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not self.height or not self.width:
                    raise ValueError("not a frame of 8 bits with a size")
                self.parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline frame")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                for i in range(body[0]):
                    for part in self.parts:
                        if part[0] == body[1 + 2 * i]:
                            part[4], part[5] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                break
        self.scan = at

    @property
    def plain(self) -> bool:
        """One component, every block 16 bits: the end of block at once, and code plus magnitude 15 bits."""
        if len(self.parts) != 1 or self.restart:
            return False
        dc, ac = self.tables[self.parts[0][4]], self.tables[0x10 | self.parts[0][5]]
        return ac == _PLAIN_AC and all(length + symbol == _DC_BITS for _, length, symbol in _codes(*dc))

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.height // 8), -(-self.width // 8)


@lru_cache(8)
def _differences(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """The difference of each 16-bit word of a plain scan; others are 32767."""
    out = np.full(1 << 16, 32767, np.int32)
    for code, length, magnitude in _codes(list(counts), list(symbols)):
        extra = np.arange(1 << magnitude)
        value = np.where(extra >> max(magnitude - 1, 0), extra, extra - (1 << magnitude) + 1) if magnitude else extra
        out[((code << magnitude) | extra) << 1] = value
    return out


def _levels(jpeg: Jpeg, coefficients: np.ndarray) -> np.ndarray:
    """Mean grey of blocks from the DC coefficients of the first component."""
    step = jpeg.steps[jpeg.parts[0][3]]
    return np.clip(np.rint(coefficients * (step / 8.0)) + 128, 0, 255).astype(np.uint8)


def _by_symbol(jpeg: Jpeg, data: bytes, whole: bool = False) -> np.ndarray:
    """DC coefficients of the first component's blocks in raster order, by reading every Huffman symbol; whole: all
    coefficients, in the order they are coded."""
    tables = {kind: {(length, code): symbol for code, length, symbol in _codes(*t)} for kind, t in jpeg.tables.items()}
    wide, tall = max(p[1] for p in jpeg.parts), max(p[2] for p in jpeg.parts)
    if len(jpeg.parts) == 1:
        wide = tall = jpeg.parts[0][1] = jpeg.parts[0][2] = 1
    columns, rows = -(-jpeg.width // (8 * wide)), -(-jpeg.height // (8 * tall))
    first = jpeg.parts[0]
    if rows * columns * sum(p[1] * p[2] for p in jpeg.parts) * 2 > 8 * (len(data) - jpeg.scan):  # two bits a block at least
        raise ValueError("more blocks than bytes")
    out = np.zeros((rows * first[2], columns * first[1], 64 if whole else 1), np.int32)
    at, hold, held = jpeg.scan, 0, 0

    def bits(n: int) -> int:
        nonlocal at, hold, held
        while held < n:
            if at > len(data) + 8:
                raise ValueError("a scan that ends early")
            byte = data[at] if at < len(data) else 0
            at += 1
            if byte == 0xFF:
                at += 1  # a stuffed zero
            hold, held = ((hold << 8) | byte) & 0xFFFFFFFF, held + 8
        held -= n
        return (hold >> held) & ((1 << n) - 1)

    def symbol(table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bits(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    before = [0] * len(jpeg.parts)
    for unit in range(rows * columns):
        if jpeg.restart and unit and unit % jpeg.restart == 0:
            hold = held = 0
            at = data.index(b"\xff", at) + 2
            before = [0] * len(jpeg.parts)
        for n, (_, h, v, _, dc, ac) in enumerate(jpeg.parts):
            for block in range(h * v):
                size = symbol(tables[dc])
                extra = bits(size) if size else 0
                before[n] += extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
                place = out[unit // columns * v + block // h, unit % columns * h + block % h] if n == 0 else None
                if n == 0:
                    place[0] = before[0]
                k = 1
                while k < 64:
                    run = symbol(tables[0x10 | ac])
                    if run == 0:
                        break
                    k += run >> 4
                    if size := run & 15:
                        extra = bits(size)
                        if whole and n == 0 and k < 64:
                            place[k] = extra if extra >> (size - 1) else extra - (1 << size) + 1
                    k += 1
    out = out[: -(-jpeg.height // 8), : -(-jpeg.width // 8)]
    return out if whole else out[:, :, 0]


def _cosines() -> np.ndarray:
    """Rows of the cosine transform of 8 values."""
    k, x = np.arange(8)[:, None], np.arange(8)
    return np.sqrt(np.where(k, 2, 1) / 8) * np.cos((2 * x + 1) * k * np.pi / 16)


def pixels(frame: bytes) -> np.ndarray:
    """The first component's samples of a baseline frame, rows by columns: dequantised and inverse-transformed blocks."""
    jpeg = Jpeg(frame)
    coded = _by_symbol(jpeg, frame, whole=True) * jpeg.whole_steps[jpeg.parts[0][3]]
    blocks = np.empty_like(coded)
    blocks[:, :, _ZIGZAG] = coded
    rows, columns, _ = blocks.shape
    turn = _cosines()
    samples = turn.T @ blocks.reshape(rows, columns, 8, 8).astype(float) @ turn
    grey = np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8)
    wide, tall = max(p[1] for p in jpeg.parts), max(p[2] for p in jpeg.parts)  # a thinned component is smaller
    height, width = -(-jpeg.height * jpeg.parts[0][2] // tall), -(-jpeg.width * jpeg.parts[0][1] // wide)
    return grey.transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)[:height, :width]


def decode(frames: list[bytes]) -> list[np.ndarray]:
    """Mean grey of each frame's blocks, row by row. Frames may differ in size; an empty one repeats the one before it."""
    first = next((f for f in frames if f), None)
    if first is None:
        return [np.zeros(0, np.uint8)] * len(frames)
    jpeg = Jpeg(first)
    head = first[: jpeg.scan]
    blocks = jpeg.grid[0] * jpeg.grid[1]
    size = jpeg.scan + 2 * blocks + 2
    if jpeg.plain and all(len(f) == size and f.startswith(head) for f in frames):
        dc = jpeg.tables[jpeg.parts[0][4]]
        words = np.frombuffer(b"".join(f[jpeg.scan : -2] for f in frames), ">u2").reshape(len(frames), blocks)
        diffs = _differences(tuple(dc[0]), tuple(dc[1]))[words]
        if not ((words >> 8 == 0xFF).any() or (words & 0xFF == 0xFF).any() or (diffs == 32767).any()):
            return list(_levels(jpeg, diffs.cumsum(axis=1)))
    out = []
    for f in frames:
        if f:
            jpeg = Jpeg(f)
            out.append(_levels(jpeg, _by_symbol(jpeg, f)).ravel())
        else:
            out.append(out[-1] if out else np.zeros(0, np.uint8))
    return out


def shots(levels: Sequence[np.ndarray]) -> list[tuple[int, int, float]]:
    """(first frame, end frame, difference at its start) of shots; histograms are shares of a frame's blocks."""
    number = len(levels)
    if not number:
        return []
    sizes = np.array([len(x) for x in levels])
    place = (np.concatenate(levels) >> 4).astype(np.int64) + HISTOGRAM_BINS * np.repeat(np.arange(number), sizes)
    counts = np.bincount(place, minlength=HISTOGRAM_BINS * number).reshape(number, HISTOGRAM_BINS) / np.maximum(sizes, 1)[:, None]
    diffs = np.abs(np.diff(counts, axis=0)).sum(axis=1) / 2
    starts, strengths = [0], [0.0]
    for i, diff in enumerate(diffs.tolist()):
        near = diffs[max(0, i - WINDOW) : i]
        usual = near.mean() + SPREADS * near.std() if len(near) >= 2 else 0.5
        if diff > max(LEAST, usual):
            starts.append(i + 1)
            strengths.append(diff)
    return list(zip(starts, [*starts[1:], number], strengths))


def payload_of(data: bytes) -> tuple[bytes, list[tuple[int, int, float]], int]:
    """The bytes that `store` put in a file, its shots, and its frames' microseconds."""
    frames, micros, length = parse(data)
    levels = decode(frames)
    return b"".join(x.tobytes() for x, f in zip(levels, frames) if f)[:length], shots(levels), micros


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("_bytes")).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(batch):  # slices of about 2 MB
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (2 << 20), side="right")))
            part = batch.slice(start, stop - start)
            files = []
            for value in part.column("_bytes"):
                raw = value.as_py()
                files.append(encode(raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)))
            at = part.schema.get_field_index("_bytes")
            yield part.set_column(at, "media", pa.array(files, pa.binary()))
            start = stop


def store(rows: DataFrame, data: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_bytes and media: the AVI file of each row's text or bytes, padded with zeros to a multiple of 64."""
    raw = F.coalesce(F.col(data).cast("binary"), F.lit(b""))
    rows = rows.select(*keep, F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias("_bytes"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_bytes")
    return rows.mapInArrow(_stored, f"{kept}, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column("media"):
            payload, found, _ = payload_of(value.as_py())
            feature = f"shots={len(found)};cuts=" + ",".join(f"{start}:{strength:.4f}" for start, _, strength in found[1:])
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), feature))
        columns = list(zip(*rows)) if rows else [()] * 4
        own = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())]
        names = [n for n in batch.schema.names if n != "media"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *own], names=[*names, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])


def read_back(stored: DataFrame) -> DataFrame:
    """The columns beside media, digests of media and of the payload that reading it gives, and its shots as text."""
    rows = stored.select("*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "media")
    return rows.mapInArrow(_read, f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def _whole_frames(frames: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for f in frames:
        out.append(pixels(f).ravel() if f else out[-1] if out else np.zeros(0, np.uint8))
    return out


def shots_of(data: bytes, whole: bool = False) -> tuple[list[tuple[int, int, float]], int]:
    """The shots of a file and its frames' microseconds; whole: by pixels, not blocks."""
    frames, micros, _ = parse(data)
    return shots((_whole_frames if whole else decode)(frames)), micros


def _clipped(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for n, value in enumerate(batch.column("media")):
            try:
                found, micros = shots_of(value.as_py() or b"", whole)
            except (ValueError, KeyError, IndexError, struct.error):
                continue  # documented: no clips
            for clip, (start, end, strength) in enumerate(found):
                at.append(n)
                rows.append((clip, start, end, start * micros / 1e6, end * micros / 1e6, strength))
        if rows:
            names = [n for n in batch.schema.names if n != "media"]
            kept = [batch.column(n).take(pa.array(at)) for n in names]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            own = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([*kept, *own], names=[*names, "clip", "first_frame", "end_frame", "start_s", "end_s", "strength"])


def clips(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",), whole: bool = False) -> DataFrame:
    """One row per shot: keep columns, clip, first_frame, end_frame, start_s, end_s, strength. whole: by decoded pixels."""
    rows = media.select(*keep, F.col(column).alias("media"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "media")
    return rows.mapInArrow(partial(_clipped, whole=whole), f"{kept}, clip int, first_frame long, end_frame long, start_s double, end_s double, strength double")
