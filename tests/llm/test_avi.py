"""AVI files that `store` does not write: frames of several sizes, repeats, OpenDML, more streams, colour, restarts."""

import struct

import numpy as np

from quern.llm import avi_media as avi


def grey(rows, columns, value):
    """A stored frame of one grey."""
    payload = bytes([value]) * (rows * 32)
    assert columns == 32
    return avi.parse(avi.encode(payload))[0][0]


def film(frames, streams=(b"vids",), names=None, index="old", more=()):
    """An AVI file of frames; `more` are the frames of a second RIFF list."""
    names = names or [b"00dc"] * len(frames)
    head = b"".join(avi._list(b"strl", avi._chunk(b"strh", kind + b"\0" * 52)) for kind in streams)
    header = avi._list(b"hdrl", avi._chunk(b"avih", struct.pack("<14I", 100_000, *[0] * 13)), head)
    chunks, entries, at = [], [], 4
    for name, frame in zip(names, frames):
        chunks.append(avi._chunk(name, frame))
        entries.append(struct.pack("<4sIII", name, 16, at, len(frame)))
        at += len(chunks[-1])
    body = [header, avi._list(b"movi", *chunks)]
    if index == "old":
        body.append(avi._chunk(b"idx1", b"".join(entries)))
    out = avi._chunk(b"RIFF", b"AVI " + b"".join(body))
    if more:
        out += avi._chunk(b"RIFF", b"AVIX" + avi._list(b"movi", *(avi._chunk(b"00dc", f) for f in more)))
    return out


def test_frames_of_two_sizes_all_stay():
    frames = [grey(1, 32, 10), grey(2, 32, 20), grey(2, 32, 20), grey(1, 32, 200), grey(1, 32, 200)]
    found, micros, length = avi.parse(film(frames))
    levels = avi.decode(found)
    assert micros == 100_000 and length is None
    assert [(len(x), int(x[0])) for x in levels] == [(32, 10), (64, 20), (64, 20), (32, 200), (32, 200)]
    assert [a for a, _, _ in avi.shots(levels)][1:] == cuts_by_hand(levels) == [1]


def test_empty_frames_repeat_and_keep_time():
    frames = [grey(1, 32, 10), b"", b"", grey(1, 32, 250), b""]
    levels = avi.decode(avi.parse(film(frames))[0])
    assert [int(x[0]) for x in levels] == [10, 10, 10, 250, 250]
    assert [int(x[0]) for x in avi.decode(avi.parse(film(frames, index=None))[0])] == [10, 10, 10, 250, 250]


def test_second_list_and_first_video_stream_count():
    frames = [b"sound", grey(1, 32, 10), b"sound", grey(1, 32, 30)]
    data = film(frames, (b"auds", b"vids"), [b"00wb", b"01dc", b"00wb", b"01dc"])
    assert [int(x[0]) for x in avi.decode(avi.parse(data)[0])] == [10, 30]
    data = film([grey(1, 32, 10)], more=[grey(1, 32, 40), grey(1, 32, 50)])
    assert [int(x[0]) for x in avi.decode(avi.parse(data)[0])] == [10, 40, 50]


def test_open_dml_index_names_the_frames():
    frames = [grey(1, 32, v) for v in (5, 15, 25)]
    first = film(frames, index=None)
    starts = [first.index(f) for f in frames]
    standard = struct.pack("<HBBI4sQI", 2, 0, 1, 3, b"00dc", 0, 0)
    # the index goes into the stream's list, so everything behind moves by its length
    length = 8 + len(standard) + 24
    entries = b"".join(struct.pack("<II", at + length, len(f)) for at, f in zip(starts, frames))
    at = first.index(b"strh") + 8 + 56
    data = bytearray(first[:at] + avi._chunk(b"indx", standard + entries) + first[at:])
    for name in (b"RIFF", b"LIST"):
        place = data.index(name) + 4
        struct.pack_into("<I", data, place, struct.unpack_from("<I", data, place)[0] + length)
    place = data.index(b"LIST", data.index(b"avih")) + 4
    struct.pack_into("<I", data, place, struct.unpack_from("<I", data, place)[0] + length)
    made = avi.Avi(bytes(data))
    assert made.places == [(s + length, len(f)) for s, f in zip(starts, frames)]
    assert [int(x[0]) for x in avi.decode(avi.parse(bytes(data))[0])] == [5, 15, 25]


def coloured(levels, restart):
    """A baseline frame of 4:2:0 colour, 16 x 16 pixels a unit; levels: first component's DC steps of 4 blocks a unit."""
    dc = ([0, 0, 0, 9] + [0] * 12, list(range(9)))  # every magnitude has four bits
    ac = ([1, 1] + [0] * 14, [0x00, 0x01])  # end of block, and one coefficient of size 1
    bits, segments, before = "", [], 0

    def block(diff):
        size = abs(diff).bit_length()
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        return f"{size:04b}" + (f"{extra:0{size}b}" if size else "") + "10" + "1" + "0"  # an AC coefficient of +1, then the end

    for n, unit in enumerate(levels):
        if restart and n and n % restart == 0:
            segments.append(bits)
            bits, before = "", 0
        for level in unit:
            bits += block(level - before)
            before = level
        bits += block(0) * 2
    segments.append(bits)
    out = b""
    for k, own in enumerate(segments):
        own += "1" * (-len(own) % 8)
        out += bytes(int(own[i : i + 8], 2) for i in range(0, len(own), 8)).replace(b"\xff", b"\xff\0")
        out += bytes([0xFF, 0xD0 + k % 8]) if k < len(segments) - 1 else b""
    size = struct.pack(">BHHB", 8, 16, 16 * len(levels), 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = avi._segment(0xC4, bytes([0x00, *dc[0], *dc[1]])) + avi._segment(0xC4, bytes([0x10, *ac[0], *ac[1]]))
    again = avi._segment(0xDD, struct.pack(">H", restart)) if restart else b""
    scan = avi._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return b"\xff\xd8" + avi._segment(0xDB, b"\0" + bytes([8] * 64)) + avi._segment(0xC0, size) + tables + again + scan + out + b"\xff\xd9"


def test_colour_with_coefficients_and_restarts():
    rng = np.random.default_rng(1)
    levels = rng.integers(-120, 120, (5, 4)).tolist()
    for restart in (0, 1, 2):
        found = avi.decode([coloured(levels, restart)])[0].reshape(2, 10)
        want = np.array([[u[0], u[1]] for u in levels]).ravel(), np.array([[u[2], u[3]] for u in levels]).ravel()
        assert (found == np.stack(want) + 128).all()


def test_clips_are_timed_by_frame(spark):
    data = film([grey(1, 32, 10)] * 4 + [b""] + [grey(2, 32, 240)] * 3)
    rows = avi.clips(spark.createDataFrame([(1, data)], "doc_id long, media binary")).orderBy("clip").collect()
    assert [(r.first_frame, r.end_frame, r.start_s, r.end_s) for r in rows] == [(0, 5, 0.0, 0.5), (5, 8, 0.5, 0.8)]


def cuts_by_hand(levels):
    """Shots by the stated rule, frame by frame."""
    shares = [[sum(int(v) // 16 == b for v in x) / len(x) for b in range(16)] for x in levels]
    diffs = [sum(abs(a - b) for a, b in zip(x, y)) / 2 for x, y in zip(shares, shares[1:])]
    cuts = []
    for i, d in enumerate(diffs):
        near = diffs[max(0, i - 8) : i]
        mean = sum(near) / len(near) if near else 0
        usual = mean + 2.5 * (sum((x - mean) ** 2 for x in near) / len(near)) ** 0.5 if len(near) >= 2 else 0.5
        cuts += [i + 1] if d > max(0.08, usual) else []
    return cuts


def test_shots_follow_the_rule():
    rng = np.random.default_rng(3)
    for _ in range(20):
        centres = np.repeat(rng.integers(0, 256, 6), rng.integers(1, 9, 6))
        levels = [np.clip(rng.normal(c, 12, 64), 0, 255).astype(np.uint8) for c in centres]
        assert [a for a, _, _ in avi.shots(levels)][1:] == cuts_by_hand(levels)
