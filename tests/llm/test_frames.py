"""Frames of other writers: standard Huffman tables, whole coefficients against a plain transform, hostile files."""

import struct
import time

import numpy as np
import pytest

from quern.llm import avi_media as V


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, size):
        self.text += format(value, f"0{size}b") if size else ""

    def data(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b""


def transformed(block):
    """Cosine transform of 8 x 8 values by its definition."""
    out = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            scale = (0.5 if u else 8**-0.5) * (0.5 if v else 8**-0.5)
            out[u, v] = scale * sum(block[x, y] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for x in range(8) for y in range(8))
    return out


def zigzag():
    """Places in coding order, by walking."""
    at, out, up = [0, 0], [], True
    while len(out) < 64:
        out.append(at[0] * 8 + at[1])
        r, c = at
        if up:
            at = [r + 1, c] if c == 7 else [r, c + 1] if r == 0 else [r - 1, c + 1]
            up = not (c == 7 or r == 0)
        else:
            at = [r, c + 1] if r == 7 else [r + 1, c] if c == 0 else [r + 1, c - 1]
            up = r == 7 or c == 0
    return out


def grey_frame(image, steps, tables=True):
    """A baseline frame of one component, coded with the standard tables."""
    codes = {kind: {symbol: (code, size) for code, size, symbol in V._codes(*t)} for kind, t in V._standard().items()}
    height, width = image.shape
    padded = np.pad(image.astype(float) - 128, ((0, -height % 8), (0, -width % 8)), mode="edge")
    bits, before, order = Bits(), 0, zigzag()

    def number(v):
        size = int(abs(v)).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    for y in range(0, padded.shape[0], 8):
        for x in range(0, padded.shape[1], 8):
            coded = np.rint(transformed(padded[y : y + 8, x : x + 8]).ravel()[order] / steps).astype(int).tolist()
            size, extra = number(coded[0] - before)
            before = coded[0]
            bits.put(*codes[0x00][size])
            bits.put(extra, size)
            run = 0
            for k in range(1, 64):
                if not any(coded[k:]):
                    bits.put(*codes[0x10][0])
                    break
                if coded[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    bits.put(*codes[0x10][0xF0])
                    run -= 16
                size, extra = number(coded[k])
                bits.put(*codes[0x10][run << 4 | size])
                bits.put(extra, size)
                run = 0
    head = b"\xff\xd8" + V._segment(0xDB, b"\0" + bytes(steps.tolist())) + V._segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
    if tables:
        head += b"".join(V._segment(0xC4, bytes([k, *c, *s])) for k, (c, s) in V._standard().items())
    return head + V._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + bits.data() + b"\xff\xd9"


def film(frames):
    movie = V._list(b"movi", *(V._chunk(b"00dc", f) for f in frames))
    return V._chunk(b"RIFF", b"AVI " + V._list(b"hdrl", V._chunk(b"avih", struct.pack("<14I", 40_000, *[0] * 13)), V._list(b"strl", V._chunk(b"strh", b"vidsMJPG" + bytes(48)))) + movie)


@pytest.mark.parametrize("tables", [True, False])
@pytest.mark.parametrize("shape", [(8, 8), (24, 40), (13, 21)])
def test_pixels_come_back_with_and_without_tables(shape, tables):
    rng = np.random.default_rng(4)
    image = np.clip(128 + 60 * np.sin(np.arange(shape[0])[:, None] / 3) + 40 * np.cos(np.arange(shape[1]) / 2) + rng.normal(size=shape) * 12, 0, 255).astype(np.uint8)
    fine = V.pixels(grey_frame(image, np.ones(64, int), tables))
    assert fine.shape == shape and np.abs(fine.astype(int) - image).max() <= 2
    coarse = V.pixels(grey_frame(image, np.arange(3, 67), tables))
    assert 0 < np.abs(coarse.astype(int) - image).mean() < 20
    small = V.decode([grey_frame(image, np.ones(64, int), tables)])[0]
    if not (shape[0] % 8 or shape[1] % 8):
        means = image.reshape(shape[0] // 8, 8, shape[1] // 8, 8).mean(axis=(1, 3)).ravel()
        assert np.abs(small.astype(float) - means).max() <= 1


def test_standard_tables_are_whole():
    for kind, (counts, symbols) in V._standard().items():
        assert sum(counts) == len(symbols) == len(set(symbols)) == (162 if kind & 0x10 else 12)


def test_shots_by_pixels_see_what_blocks_average_away(spark):
    flat = np.full((32, 32), 120, np.uint8)
    checks = np.where((np.arange(32)[:, None] + np.arange(32)) % 2, 20, 220).astype(np.uint8)  # the same mean in every block
    data = film([grey_frame(f, np.ones(64, int), False) for f in [flat] * 12 + [checks] * 12])
    media = spark.createDataFrame([(1, data), (2, b"junk"), (3, None)], "doc_id long, media binary")
    whole = [(r.doc_id, r.first_frame, r.end_frame, r.start_s) for r in V.clips(media, whole=True).orderBy("first_frame").collect()]
    assert whole == [(1, 0, 12, 0.0), (1, 12, 24, 0.48)]
    assert [(r.first_frame, r.end_frame) for r in V.clips(media).collect()] == [(0, 24)]


def test_hostile_files_give_no_clips(spark):
    deep = b""
    for _ in range(3000):
        deep = V._list(b"abcd", deep)
    nested = V._chunk(b"RIFF", b"AVI " + deep)
    nested_movie = V._chunk(b"RIFF", b"AVI " + V._list(b"movi", deep))
    frame = bytearray(grey_frame(np.full((8, 8), 9, np.uint8), np.ones(64, int), False))
    at = bytes(frame).index(b"\xff\xc0") + 5
    frame[at : at + 4] = b"\xff\xff\xff\xff"  # 65535 x 65535
    cut = grey_frame(np.full((64, 64), 9, np.uint8), np.ones(64, int))[:-12]
    rows = [(1, nested), (2, nested_movie), (3, film([bytes(frame)])), (4, film([cut[:40]])), (5, film([b"\xff\xd8" * 3]))]
    began = time.time()
    found = V.clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert not {r.doc_id for r in found} - {2} and time.time() - began < 30
