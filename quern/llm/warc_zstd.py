"""WARC archives as seekable Zstandard bundles.

A bundle holds WARC/1.1 records in independent frames: a frame is closed when its records reach FRAME bytes, a bundle when
its own reach BUNDLE bytes. A last, skippable frame is the seek table: the compressed and the plain size of every frame,
so that a reader finds any frame from the file's end and decompresses it alone. The index maps each record identifier to
(bundle, frame, offset in the plain frame, length).

Of records with equal payloads the one with the largest id is a response, an HTTP message with the payload; the others are
revisits of it, which hold the HTTP head only, whose Content-Length is that of the full payload. Payloads of fewer than
`least` bytes are always responses. Digests are SHA-1 in base32; payloads are told apart by digest and length.

A payload is exchanged once, compressed, with what its record is to be, by its own id; what says so is narrow: ids, digests and
lengths. Its largest groups of copies are dealt over SALTS parts, by which their largest id is found and handed back.
Bundles are rows of a written table, as only Spark reaches every store; `save` writes them as files.

Defined results: a null payload is an empty one. A null id is less than all others; of rows alike in id and payload the
first is what the largest is, the others revisit it. A null address leaves out Target-URI; control characters, spaces and
others outside ASCII are percent-encoded in it. Extra columns are dropped. An empty table gives no bundles and no rows.
A record is held whole in its task.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import small_batches, staged

#: Plain bytes of records after which a frame, and of frames after which a bundle, is closed.
FRAME, BUNDLE = 256 << 10, 16 << 20
#: Parts over which copies of one payload are dealt to learn their largest id.
SALTS = 256
#: Fixed values of the seekable format: the skippable frame that holds the table, and the table's own mark.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD, _URI = "urn:page:", "WARC-Refers-To-Target-URI"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The last frame of a bundle: (compressed, plain) size of each frame, their number, no checksums."""
    entries = b"".join(struct.pack("<II", *pair) for pair in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the last bytes of a bundle."""
    number, flags, mark = struct.unpack("<IBI", data[-9:])
    if mark != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    out, start = [], 0
    for k in range(number):
        at = len(data) - 9 - width * (number - k)
        packed, plain = struct.unpack("<II", data[at : at + 8])
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(data: bytes, frame: int) -> bytes:
    """One frame of a bundle, decompressed alone."""
    start, packed, plain = read_seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=plain)


class Bundle:
    """Records gathered into frames, and where each of them stands."""

    def __init__(self, level: int):
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open_size = self.size = 0

    def add(self, identifier: str, record: bytes) -> None:
        if self.open_size and self.open_size + len(record) > FRAME:
            self.close_frame()
        self.index.append((identifier, len(self.frames), self.open_size, len(record)))
        self.open.append(record)
        self.open_size += len(record)
        self.size += len(record)

    def close_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_size))
            self.open, self.open_size = [], 0

    def data(self) -> bytes:
        self.close_frame()
        return b"".join(self.frames) + seek_table(self.sizes)


def identifier(key: str, copy: int) -> str:
    """A record's identifier: its row's key (in hex beyond plain characters) and the number of the copy."""
    return f"{_RECORD}{quote(key, safe='')}:{copy}"


def record(kind: str, own: str, url: str | None, digest: str, length: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record with its two line breaks."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


#: What stands in addresses as it is.
_SAFE = "!#$%&'()*+,/:;=?@[]~"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(WARC headers, HTTP headers, payload, end) of the record that begins at a byte."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record begins here")
    head = dict(line.split(": ", 1) for line in lines[1:])
    begin, length = stop + 4, int(head["Content-Length"])
    block = data[begin : begin + length]
    middle = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:middle].decode().split("\r\n")[1:])
    return head, http, block[middle + 4 :], begin + length + 4


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def roles(keys: DataFrame, least: int = 0) -> DataFrame:
    """_id, _digest, _size, _first, _refers of each distinct (id, digest, length): whether its first row is a response, and
    the largest id of the payload. keys: _id, _digest, _size.

    The largest id of a payload is found in SALTS parts, then over them, and goes back to the parts that hold it, so a
    payload that a third of the rows share is spread over all tasks."""
    salted = keys.distinct().withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    parts = salted.groupBy("_digest", "_size", "_salt").agg(F.max("_id").alias("_most"))
    best = parts.groupBy("_digest", "_size").agg(F.max("_most").alias("_refers"), F.collect_list("_salt").alias("_salts"))  # at most SALTS of them
    back = best.select("_digest", "_size", "_refers", F.explode("_salts").alias("_salt"))
    first = F.col("_id").eqNullSafe(F.col("_refers")) | (F.col("_size") < least)
    return salted.join(back, ["_digest", "_size", "_salt"]).select("_id", "_digest", "_size", first.alias("_first"), "_refers")


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads compressed one by one, for their exchange."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        at = batch.schema.get_field_index("_payload")
        columns = list(batch.columns)
        columns[at] = pa.array([packer.compress(v.as_buffer()) for v in columns[at]], pa.binary())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _writing(least: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, bundle = TaskContext.get().partitionId(), 0, Bundle(level)
        unpacker = zstandard.ZstdDecompressor()

        def out() -> pa.RecordBatch:
            index = [{"record": r, "frame": f, "offset": o, "length": n} for r, f, o, n in bundle.index]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()), pa.array([bundle.data()], pa.binary()), pa.array([index], pa.list_(_ENTRY))], names=["bundle", "data", "index"]
            )

        for batch in batches:
            for row in batch.to_pylist():
                payload, key, copy = row["_payload"], row["_key"], row["_copy"]
                small = row["_size"] < least
                response = small or (row["_first"] and copy == 0)
                digest = base64.b32encode(bytes.fromhex(row["_digest"])).decode()
                own = identifier(key, copy)
                refers = None if response else identifier(row["_refers_key"], 0)
                bundle.add(own, record("response" if response else "revisit", own, row["_url"], digest, row["_size"], unpacker.decompress(payload) if response else b"", refers))
                if bundle.size >= BUNDLE:
                    yield out()
                    number, bundle = number + 1, Bundle(level)
        if bundle.index:
            yield out()

    return run


_ENTRY = pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_BUNDLES = "bundle long, data binary, index array<struct<record: string, frame: int, offset: long, length: long>>"


def _key(c: Column) -> Column:
    """The id as text; of null, nothing, which no other id's text is."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def write(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, level: int = 3) -> DataFrame:
    """bundle, data, index: a record for each row, in bundles, written."""
    small_batches(pages.sparkSession, 1000)
    whole = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(id_column).alias("_id"), F.col(url).alias("_url"), whole.alias("_payload"), F.sha1(F.encode(whole, "UTF-8")).alias("_digest"), F.octet_length(whole).cast("long").alias("_size"))
    packed = rows.mapInArrow(_packing, f"_id {rows.schema['_id'].dataType.simpleString()}, _url string, _payload binary, _digest string, _size long")
    told = roles(rows.select("_id", "_digest", "_size"), least).withColumnsRenamed({"_id": "_k", "_digest": "_d", "_size": "_s"})
    met = packed.join(told, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d")) & (F.col("_size") == F.col("_s")))
    copies = Window.partitionBy("_id", "_digest", "_size").orderBy("_url")
    ready = met.withColumn("_copy", F.row_number().over(copies) - 1)
    ready = ready.select("_payload", "_url", "_digest", "_size", "_first", "_copy", _key(F.col("_id")).alias("_key"), _key(F.col("_refers")).alias("_refers_key"))
    return staged(ready.mapInArrow(_writing(least, level), _BUNDLES))


def index(bundles: DataFrame) -> DataFrame:
    """record, bundle, frame, offset, length: where each record stands."""
    return bundles.select("bundle", F.explode("index").alias("_e")).select(F.col("_e.record").alias("record"), "bundle", "_e.frame", "_e.offset", "_e.length")


def _id_of(identifier: str) -> str | None:
    key = unquote(identifier.removeprefix(f"<{_RECORD}").rsplit(":", 1)[0])
    return key[1:] if key else None


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in batch.column("data"):
            data = cell.as_py()
            for frame, (start, packed, plain) in enumerate(read_seek_table(data)):
                text, at, out = zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=plain), 0, []
                while at < len(text):
                    head, http, payload, end = parse(text, at)
                    size, digest = int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"{head['WARC-Record-ID']} is damaged")
                    refers = head.get("WARC-Refers-To")
                    out.append((_id_of(head["WARC-Record-ID"]), size, digest, kind, _id_of(refers) if refers else None, head["WARC-Record-ID"][1:-1], frame, at, end - at))
                    at = end
                columns = list(zip(*out))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_READ_NAMES)


_READ = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, record string, frame int, offset long, length long"
_READ_NAMES = [c.split()[0] for c in _READ.split(", ")]


def read_back(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, read frame by frame through the seek tables; responses are checked against their digest."""
    return bundles.select("data").mapInArrow(_reading, _READ)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """record, payload (null for revisits) of the wanted records (a column `record`): one frame each is decompressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, names, out = {}, [], []
                for e in row["_wanted"]:
                    if e["frame"] not in held:
                        held = {e["frame"]: read_frame(row["data"], e["frame"])}  # entries stand in the order of frames
                    head, _, payload, _ = parse(held[e["frame"]], e["offset"])
                    names.append(e["record"])
                    out.append(payload if head["WARC-Type"] == "response" else None)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["record", "payload"])

    found = index(bundles).join(wanted.select("record").distinct(), "record")
    asked = found.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "record"))).alias("_wanted"))  # a bundle's at most
    return bundles.join(asked, "bundle").select("data", "_wanted").mapInArrow(run, "record string, payload binary")


def save(bundles: DataFrame, folder: str) -> DataFrame:
    """path of the file that each bundle is written to, by the tasks, in a folder or store that all executors reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        store.create_dir(root)
        for batch in batches:
            paths = [f"{root}/{n}.warc.zst" for n in batch.column("bundle").to_pylist()]
            for path, cell in zip(paths, batch.column("data")):
                with store.open_output_stream(path, compression=None) as file:
                    file.write(cell.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return bundles.select("bundle", "data").mapInArrow(run, "path string")
