"""Motion-JPEG in AVI: bytes stored as lossless samples, RIFF indexes, intra frames, shots and timed clips."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import map_arrow, raw_texts, slices, table, whole_text

#: Blocks of a frame; each carries one sample, and a payload is a whole number of frames.
ACROSS, DOWN = 16, 12
FRAME = ACROSS * DOWN
RATE = 25

#: Fixed value of the JPEG standard: the order of coefficients.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


# ---------------------------------------------------------------- writing


@cache
def sample_words() -> np.ndarray:
    """The 16 bits that code a block, by its difference from the block before plus 255.

    A difference of s bits gets a Huffman code of 12 - s bits, so that code and bits are 12 together; the end of the
    block takes 4 more. Every block then has 16 bits, which a reader can see from the tables.
    """
    words, code = np.zeros(511, ">u2"), 0
    for size in range(8, -1, -1):
        for d in range(-255, 256):
            if abs(d).bit_length() == size:
                words[d + 255] = (code << size | (d if d >= 0 else d + (1 << size) - 1)) << 4
        code = (code + 1) << 1
    return words


@cache
def frame_parts() -> tuple[bytes, bytes]:
    """What stands before and behind the coded samples in each frame."""

    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    quantum = segment(0xDB, bytes([0, 8] + [1] * 63))  # 8 for the mean: its unit is then one level of a sample
    size = segment(0xC0, struct.pack(">BHHB", 8, DOWN * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0]))
    means = segment(0xC4, bytes([0x00] + [1 if 4 <= n <= 12 else 0 for n in range(1, 17)]) + bytes(range(8, -1, -1)))
    rest = segment(0xC4, bytes([0x10] + [1 if n == 4 else 0 for n in range(1, 17)]) + bytes([0]))
    scan = segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + quantum + size + means + rest + scan, b"\xff\xd9"


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload, one byte a block; its length is a positive multiple of FRAME."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int16)
    count = len(samples)
    steps = np.diff(samples, axis=1, prepend=np.int16(128))
    words = sample_words()[steps + 255]
    before, behind = frame_parts()
    length = len(before) + 2 * FRAME + len(behind)
    padded = length + length % 2
    frames = np.zeros((count, 8 + padded), np.uint8)
    frames[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", length), np.uint8)
    frames[:, 8 : 8 + len(before)] = np.frombuffer(before, np.uint8)
    frames[:, 8 + len(before) : 8 + len(before) + 2 * FRAME] = words.view(np.uint8).reshape(count, -1)
    frames[:, 8 + length - len(behind) : 8 + length] = np.frombuffer(behind, np.uint8)
    index = np.zeros((count, 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 16
    index[:, 2], index[:, 3] = 4 + np.arange(count) * (8 + padded), length
    wide, high = ACROSS * 8, DOWN * 8
    main = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, count, 0, 1, length, wide, high, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, count, length, 0xFFFFFFFF, 0, 0, 0, wide, high)
    picture = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 8, b"MJPG", wide * high, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"movi" + frames.tobytes()) + chunk(b"idx1", index.tobytes()))


# ---------------------------------------------------------------- reading


def riff_chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, begin and end of each chunk's body."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk reaches beyond its parent")
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[float, np.ndarray, np.ndarray]:
    """Frames a second, and the offset and size of each video frame as the index has them (or the list of frames, if
    there is no index)."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    rate, movie, index = 25.0, None, None
    for name, begin, end in riff_chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        if name == b"LIST" and data[begin : begin + 4] == b"hdrl":
            for inner, b, _ in riff_chunks(data, begin + 4, end):
                if inner == b"avih" and end - b >= 4 and (period := struct.unpack_from("<I", data, b)[0]):
                    rate = 1e6 / period
        elif name == b"LIST" and data[begin : begin + 4] == b"movi":
            movie = (begin, end)
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", (end - begin) // 16 * 4, begin).reshape(-1, 4)
    if movie is None:
        raise ValueError("an AVI file without frames")
    if index is None:
        found = [(b, e - b) for name, b, e in riff_chunks(data, movie[0] + 4, movie[1]) if name[2:] in (b"dc", b"db")]
        places = np.array(found, np.int64).reshape(-1, 2)
        return rate, places[:, 0], places[:, 1]
    kinds = index[:, 0] >> np.uint32(16)
    index = index[np.isin(kinds, [int.from_bytes(b"dc", "little"), int.from_bytes(b"db", "little")])].astype(np.int64)
    offsets = index[:, 2] + 8
    if len(offsets) and data[movie[0] + index[0, 2] : movie[0] + index[0, 2] + 4] == index[0, 0].astype("<u4").tobytes():
        offsets = offsets + movie[0]  # offsets count from the list's name; some writers count from the file's start
    if (offsets + index[:, 3] > len(data)).any():
        raise ValueError("the index names a frame beyond the file's end")
    return rate, offsets, index[:, 3]


def huffman(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """Symbol by length and code."""
    codes, code, at = {}, 0, 0
    for size, n in enumerate(lengths, 1):
        for _ in range(n):
            codes[size, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return codes


# Fixed values of the JPEG standard (annex K.3): codes of each length, and the first symbols of the coefficient tables; frames of
# motion JPEG that have no tables of their own use these. The rest of a coefficient table's symbols ascend.
MEAN_LENGTHS = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]))
REST_LENGTHS = (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]))
REST_FIRST = (
    bytes.fromhex("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a"),
    bytes.fromhex("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
)


@cache
def standard_codes() -> dict[int, dict[tuple[int, int], int]]:
    """The standard's tables by class and number, as a frame names them."""
    symbols = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    found = {}
    for k in (0, 1):
        found[k] = huffman(MEAN_LENGTHS[k], bytes(range(12)))
        found[16 + k] = huffman(REST_LENGTHS[k], REST_FIRST[k] + bytes(sorted(set(symbols) - set(REST_FIRST[k]))))
    return found


class Frame:
    """The tables of a baseline JPEG and where its coded samples begin. A frame that cannot be read raises ValueError."""

    def __init__(self, data: bytes):
        try:
            self._read(data)
        except (IndexError, KeyError, struct.error) as error:
            raise ValueError("a JPEG frame is cut short or lacks a table") from error

    def _read(self, data: bytes) -> None:
        self.quanta: dict[int, np.ndarray] = {}
        self.codes = dict(standard_codes())
        self.restart, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG frame")
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quanta[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.codes[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                self.high, self.wide = struct.unpack_from(">HH", body, 1)
                self.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15 | 16) for i in range(1, 1 + 2 * body[0], 2)}
                self.begin = at
                for name, _, _, quantum in self.parts:
                    self.quanta[quantum], self.codes[self.scan[name][0]], self.codes[self.scan[name][1]]
                return
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only baseline JPEG frames are read")

    def even_words(self) -> np.ndarray | None:
        """If the tables give every block 16 bits and only a mean: the difference for each 16 bits; else None."""
        if len(self.parts) > 1 or self.restart:
            return None
        means, rest = (self.codes[k] for k in self.scan[self.parts[0][0]])
        if [*rest.values()] != [0] or len({n + s for (n, _), s in means.items()}) != 1:
            return None
        (tail, code), total = next(iter(rest)), next(n + s for (n, _), s in means.items())
        if tail + total != 16:
            return None
        steps = np.full(1 << 16, 1 << 14, np.int32)
        for (n, c), s in means.items():
            bits = np.arange(1 << s)
            steps[((c << s) + bits) << tail | code] = np.where(bits >> max(s - 1, 0) if s else bits, bits, bits - (1 << s) + 1)
        return steps

    def luma(self, data: bytes) -> np.ndarray:
        """All samples of the first component, decoded block by block."""
        bits, at, left = 0, self.begin, 0

        def take(n: int) -> int:
            nonlocal bits, at, left
            while left < n:
                if at > len(data) + 8:
                    raise ValueError("a frame's samples are cut short")
                byte = data[at] if at < len(data) else 0
                at += 2 if byte == 0xFF and at + 1 < len(data) and data[at + 1] == 0 else 1
                bits, left = (bits << 8 | byte) & 0xFFFFFFFFFF, left + 8
            left -= n
            return bits >> left & ((1 << n) - 1)

        def symbol(codes: dict) -> int:
            code = 0
            for size in range(1, 17):
                code = code << 1 | take(1)
                if (found := codes.get((size, code))) is not None:
                    return found
            raise ValueError("a code is not in the frame's table")

        def value(n: int) -> int:
            x = take(n) if n else 0
            return x if not n or x >> (n - 1) else x - (1 << n) + 1

        most_h, most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            most_h = most_v = 1
        columns, rows = -(-self.wide // (8 * most_h)), -(-self.high // (8 * most_v))
        first_h, first_v = (1, 1) if len(self.parts) == 1 else self.parts[0][1:3]
        if rows * columns > 4 * len(data):  # a block has two codes of a bit at least
            raise ValueError("a frame's samples are cut short")
        plane = np.zeros((rows * first_v * 8, columns * first_h * 8), np.uint8)
        last = dict.fromkeys((p[0] for p in self.parts), 0)
        for unit in range(columns * rows):
            if self.restart and unit and unit % self.restart == 0:
                bits = left = 0
                while at + 1 < len(data) and not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                    at += 1
                at, last = at + 2, dict.fromkeys(last, 0)
            for k, (name, h, v, q) in enumerate(self.parts):
                if len(self.parts) == 1:
                    h = v = 1
                means, rest = (self.codes[c] for c in self.scan[name])
                for block in range(h * v):
                    last[name] += value(symbol(means))
                    block_values, i = np.zeros(64, np.int32), 1
                    block_values[0] = last[name]
                    while i < 64:
                        s = symbol(rest)
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            if i > 63:
                                raise ValueError("a block has too many coefficients")
                            block_values[i] = value(s & 15)
                        i += 1
                    if k == 0:
                        y = (unit // columns * v + block // h) * 8
                        x = (unit % columns * h + block % h) * 8
                        plane[y : y + 8, x : x + 8] = inverse(block_values * self.quanta[q])
        return plane[: self.high, : self.wide]


@cache
def cosines() -> np.ndarray:
    k, n = np.mgrid[0:8, 0:8]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)


def inverse(zigzag_values: np.ndarray) -> np.ndarray:
    square = np.zeros(64)
    square[ZIGZAG] = zigzag_values
    c = cosines()
    return np.clip(np.rint(c.T @ square.reshape(8, 8) @ c + 128), 0, 255).astype(np.uint8)


def decode_frames(data: bytes, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """Samples of every frame, and how many pixels each of them stands for.

    Frames with equal tables that give every block 16 bits are read together: a block is its mean. Any other frame is
    decoded bit by bit.
    """
    if not len(offsets):
        return np.zeros((0, 0), np.uint8), 1
    first = Frame(data[offsets[0] : offsets[0] + sizes[0]])
    steps = first.even_words()
    if steps is not None and (sizes == sizes[0]).all():
        raw = np.frombuffer(data, np.uint8)
        frames = raw[offsets[:, None] + np.arange(sizes[0])]
        blocks = -(-first.wide // 8) * -(-first.high // 8)
        coded = frames[:, first.begin : first.begin + 2 * blocks]
        alike = (frames[:, : first.begin] == frames[0, : first.begin]).all()
        if alike and coded.shape[1] == 2 * blocks and not (coded == 0xFF).any() and first.wide % 8 == first.high % 8 == 0:
            differences = steps[np.ascontiguousarray(coded).view(">u2")]
            means = np.cumsum(differences, axis=1) * int(first.quanta[first.parts[0][3]][0])
            return np.clip((means + 4) // 8 + 128, 0, 255).astype(np.uint8), 64
    planes = [Frame(data[o : o + s]).luma(data[o : o + s]).reshape(-1) for o, s in zip(offsets.tolist(), sizes.tolist())]
    if len({len(x) for x in planes}) > 1:
        raise ValueError("frames of different sizes")
    return np.stack(planes), 1


# ---------------------------------------------------------------- shots


def histograms(samples: np.ndarray, bins: int = 16) -> np.ndarray:
    """Share of each frame's samples by level."""
    count = len(samples)
    levels = samples.astype(np.int64) * bins >> 8
    flat = np.bincount((levels + np.arange(count)[:, None] * bins).ravel(), minlength=count * bins)
    return flat.reshape(count, bins) / max(1, samples.shape[1])


def cuts(shares: np.ndarray, window: int = 8, strictness: float = 3.0, least: float = 0.2) -> np.ndarray:
    """Frames that begin a new shot.

    The distance of neighbouring histograms is held against mean and deviation over the ``window`` distances before
    it; a cut lies above both that adaptive threshold and ``least``. In the window, a distance counts at most as much as the
    larger of its neighbours, so that motion raises the threshold but a cut by itself does not.
    """
    if len(shares) < 2:
        return np.zeros(0, np.int64)
    distance = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    apart = np.concatenate(([0.0], distance, [0.0]))
    motion = np.minimum(distance, np.maximum(apart[:-2], apart[2:]))
    total, squares = (np.concatenate(([0.0], np.cumsum(x))) for x in (motion, motion**2))
    end = np.arange(len(distance))
    begin = np.maximum(0, end - window)
    n = np.maximum(1, end - begin)
    mean = (total[end] - total[begin]) / n
    spread = np.sqrt(np.maximum(0, (squares[end] - squares[begin]) / n - mean**2))
    return np.flatnonzero((distance > mean + strictness * spread) & (distance >= least)) + 1


def clips_of(data: bytes) -> tuple[np.ndarray, list[tuple[int, int, float, float, float]]]:
    """The samples, and for each clip: first frame, frame behind the last, both in seconds, mean level."""
    rate, offsets, sizes = read_avi(data)
    samples, _ = decode_frames(data, offsets, sizes)
    borders = [0, *cuts(histograms(samples)).tolist(), len(samples)] if len(samples) else []
    levels = samples.mean(axis=1) if len(samples) else []
    return samples, [(a, b, a / rate, b / rate, float(np.round(np.mean(levels[a:b]), 4))) for a, b in zip(borders, borders[1:])]


def padded(raw: bytes, unit: int = FRAME) -> bytes:
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def text_media(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: bool = True) -> DataFrame:
    """Each row's text as an AVI file, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature and, if ``keep``, the file itself (``media``).

    A null or empty text is one frame of spaces. Repeated rows and null ids are kept; other columns are not read. The
    feature names the frames, the clips and the mean level.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    fields += [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(fields + [("media", pa.binary())] * keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for raw in raw_texts(batch.column("text")):
                media = write_avi(padded(raw))
                samples, clips = clips_of(media)
                payload = samples.tobytes()
                feature = f"frames={len(samples)};clips={','.join(f'{a}-{b}' for a, b, *_ in clips)};level={samples.mean():.3f}"
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, *[media] * keep))
            if rows:
                yield table(schema, batch.column("doc_id"), *zip(*rows, strict=True))

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    shape = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(rows, run, shape + ", media binary" * keep)


#: What reading a damaged file may end with: wrong values, sizes beyond all bounds, places or parts that are not there.
DAMAGED = (ValueError, ArithmeticError, LookupError, AttributeError, TypeError, struct.error)


def media_clips(df: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """One row for each clip of each AVI file: doc_id, clip, first_frame, end_frame, start_s, end_s, level, error.

    Null or empty media and files without frames give no row. A file that is no AVI, is cut short or has other frames than baseline JPEG
    gives one row, with what is wrong as ``error`` and null in all clip columns; ``error`` is null in other rows.
    """
    fields = [("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int64()), ("end_frame", pa.int64())]
    schema = pa.schema([*fields, *((c, pa.float64()) for c in ("start_s", "end_s", "level")), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                try:
                    rows += [(doc, k, *clip, None) for k, clip in enumerate(clips_of(bytes(data))[1] if data else ())]
                except DAMAGED as error:
                    rows.append((doc, *[None] * 6, str(error) or type(error).__name__))
            if rows:
                yield table(schema, *zip(*rows, strict=True))

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(media_column).alias("media"))
    return map_arrow(rows, run, "doc_id long, clip int, first_frame long, end_frame long, start_s double, end_s double, level double, error string")


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False)
