"""AVI files: round trips, a second decoder, shots."""

import hashlib
import zlib

import numpy as np

from parley.llm import media as m

from .conftest import counted, pairs


def test_round_trip(spark, docs, odd):
    for df in (docs, odd):
        got = m.text_media(df).collect()
        want = []
        for i, t in pairs(df):
            raw = t.encode()
            full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            want.append((i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
        assert counted((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == counted(want)
        assert all(r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() for r in got)


def test_bitwise_decoder_agrees():
    """The general reader, block by block, finds the flat blocks that the fast one takes as means."""
    payload = bytes(np.random.default_rng(1).integers(0, 256, 384, np.uint8))
    data = m.write_avi(payload)
    _, offsets, sizes = m.read_avi(data)
    for k, (at, size) in enumerate(zip(offsets, sizes)):
        frame = data[at : at + size]
        plane = m.Frame(frame).luma(frame)
        assert plane.shape == (96, 128)
        blocks = plane.reshape(12, 8, 16, 8)
        assert (blocks.max(axis=(1, 3)) == blocks.min(axis=(1, 3))).all()
        assert blocks[:, 0, :, 0].tobytes() == payload[192 * k : 192 * (k + 1)]


class Bits:
    """Entropy-coded bits with stuffed zero bytes."""

    def __init__(self):
        self.bits = []

    def put(self, value, size):
        self.bits += [value >> k & 1 for k in range(size - 1, -1, -1)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        out = bytearray()
        for k in range(0, len(bits), 8):
            out.append(int("".join(map(str, bits[k : k + 8])), 2))
            if out[-1] == 0xFF:
                out.append(0)
        return bytes(out)


ORDER = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def encode(plane, chroma, tables, restart, with_tables):
    """A baseline frame from pixels: all coefficients, quantised by 3; with ``chroma`` two more planes at half the size; restart markers."""
    k, n = np.mgrid[0:8, 0:8]
    c = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)
    out, bits, last = bytearray(), Bits(), [0, 0, 0]

    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    def amount(v):
        size = abs(v).bit_length()
        return size, (v if v >= 0 else v + (1 << size) - 1)

    def symbol(codes, s):
        size, code = next(key for key, value in codes.items() if value == s)
        bits.put(code, size)

    def block(pixels, part, number):
        values = np.rint(c @ (pixels.astype(float) - 128) @ c.T / 3).astype(int).reshape(-1)[ORDER].tolist()
        step, last[part] = values[0] - last[part], values[0]
        size, raw = amount(step)
        symbol(tables[number], size)
        bits.put(raw, size)
        run = 0
        for k in range(1, 64):
            if not values[k]:
                run += 1
                continue
            while run > 15:
                symbol(tables[16 + number], 0xF0)
                run -= 16
            size, raw = amount(values[k])
            symbol(tables[16 + number], run << 4 | size)
            bits.put(raw, size)
            run = 0
        if run:
            symbol(tables[16 + number], 0)

    high, wide = plane.shape
    unit = 16 if chroma else 8
    units = [(y, x) for y in range(0, high, unit) for x in range(0, wide, unit)]
    for number, (y, x) in enumerate(units):
        if restart and number and number % restart == 0:
            out += bits.bytes() + bytes([0xFF, 0xD0 + (number // restart - 1) % 8])
            bits, last[:] = Bits(), [0, 0, 0]
        for v in range(0, unit, 8):
            for h in range(0, unit, 8):
                block(plane[y + v : y + v + 8, x + h : x + h + 8], 0, 0)
        for part in (1, 2) if chroma else ():
            block(np.full((8, 8), 60 * part), part, 1)
    out += bits.bytes()
    parts = [(1, 0x22, 0), (2, 0x11, 0), (3, 0x11, 0)] if chroma else [(1, 0x11, 0)]
    head = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([3] * 64)) + segment(0xC0, bytes([8]) + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([len(parts), *(b for p in parts for b in p)]))
    if with_tables:
        for number, codes in tables.items():
            ordered = sorted(codes)
            head += segment(0xC4, bytes([number]) + bytes(sum(size == n for size, _ in ordered) for n in range(1, 17)) + bytes(codes[key] for key in ordered))
    if restart:
        head += segment(0xDD, restart.to_bytes(2, "big"))
    scan = bytes([len(parts), *(b for name, _, _ in parts for b in (name, 0x00 if name == 1 else 0x11)), 0, 63, 0])
    return head + segment(0xDA, scan) + bytes(out) + b"\xff\xd9"


def test_frames_of_another_writer():
    """Frames with all coefficients, with and without tables, colour planes and restart markers are read to within the quantiser."""
    rng = np.random.default_rng(7)
    y, x = np.mgrid[0:48, 0:64]
    for chroma in (False, True):
        for restart in (0, 3):
            for with_tables in (False, True):
                plane = np.clip(128 + 90 * np.sin(x / 9 + rng.random()) * np.cos(y / 7) + rng.integers(-12, 13, (48, 64)), 0, 255).astype(np.uint8)
                frame = encode(plane, chroma, m.standard_codes(), restart, with_tables)
                read = m.Frame(frame).luma(frame)
                assert read.shape == plane.shape and np.abs(read.astype(int) - plane).max() <= 12 and np.abs(read.astype(int) - plane).mean() < 1.5


def avi_of(frames):
    movie = b"".join(m.chunk(b"00dc", f) for f in frames)
    return m.chunk(b"RIFF", b"AVI " + m.chunk(b"LIST", b"movi" + movie))


def test_clips_of_another_writer(spark):
    """Textured frames of two scenes; broken files are rows with an error and end nothing."""
    y, x = np.mgrid[0:16, 0:32]
    scenes = [np.clip(40 + 2 * x, 0, 255).astype(np.uint8), np.clip(220 - 3 * y, 0, 255).astype(np.uint8)]
    frames = [encode(scenes[k >= 6], False, m.standard_codes(), 0, False) for k in range(10)]
    good = avi_of(frames)
    progressive = frames[0].replace(b"\xff\xc0", b"\xff\xc2", 1)
    broken = [b"not a file at all", good[: len(good) // 2], avi_of([frames[0][:60]]), avi_of([progressive]), avi_of([b"\xff\xd8"]), b"RIFF", avi_of([frames[0].replace(b"\xff\xdb", b"\xff\xe1", 1)])]
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate([good, *broken])] + [(90, None), (91, bytearray())], "doc_id long, media binary")
    rows = m.media_clips(df).collect()
    assert [(r["first_frame"], r["end_frame"], r["error"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["clip"] or 0)) if r["doc_id"] == 0] == [(0, 6, None), (6, 10, None)]
    assert sorted(r["doc_id"] for r in rows if r["error"]) == list(range(1, 1 + len(broken)))
    assert all(r["clip"] is None for r in rows if r["error"])


def test_no_index():
    data = m.write_avi(bytes(range(192)) * 3)
    cut = data[: data.rindex(b"idx1")]
    cut = cut[:4] + (len(cut) - 8).to_bytes(4, "little") + cut[8:]
    assert [list(x) for x in m.read_avi(cut)[1:]] == [list(x) for x in m.read_avi(data)[1:]]


def test_shots(spark):
    payload = b"".join([bytes([10]) * 192] * 12 + [bytes([200]) * 192] * 5 + [bytes([90]) * 192] * 8)
    df = spark.createDataFrame([(1, bytearray(m.write_avi(payload))), (2, None), (3, bytearray())], "doc_id long, media binary")
    got = m.media_clips(df).orderBy("clip").collect()
    assert [(r["doc_id"], r["first_frame"], r["end_frame"], r["level"]) for r in got] == [(1, 0, 12, 10.0), (1, 12, 17, 200.0), (1, 17, 25, 90.0)]
    assert [r["start_s"] for r in got] == [0.0, 0.48, 0.68]


def test_empty(empty):
    assert m.text_media(empty).count() == 0


def test_damaged_files_are_rows(spark):
    """Files with bytes changed, cut or doubled anywhere, of the operator's own frames and another writer's: each is clips or an error."""
    rng = np.random.default_rng(11)
    y, x = np.mgrid[0:16, 0:32]
    own = [bytes(r["media"]) for r in m.text_media(spark.createDataFrame([(1, "one text " * 60), (2, "b")], "doc_id long, text string")).collect()]
    tables = m.standard_codes()
    other = avi_of([encode((x * 4 + y * k).astype(np.uint8), chroma, tables, 2, True) for chroma in (False, True) for k in (1, 2)][:2])
    files = []
    for k in range(600):
        data = bytearray((*own, other)[k % 3])
        for at in rng.integers(0, len(data), rng.integers(1, 6)).tolist():
            data[at] = int(rng.integers(0, 256))
        if k % 5 == 0:
            data = data[: int(rng.integers(0, len(data)))]
        files.append((k, data))
    found = m.media_clips(spark.createDataFrame(files, "doc_id long, media binary").repartition(4)).collect()
    assert len({r["doc_id"] for r in found if r["error"] is not None}) > 50
    assert all((r["error"] is None) == (r["first_frame"] is not None) for r in found)
