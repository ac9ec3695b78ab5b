"""GIF media columns: LZW decoding, palettes, disposal, transparency, timed frames and colour histograms.

encode_gif writes byte payloads losslessly as 8-bit samples over a palette of 256 colours; decode_gif reads any GIF89a or
GIF87a. Both run inside tasks, one value at a time, on columns that Spark partitions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 64
#: Rows of one frame; a longer payload goes on in the next frame.
MAX_ROWS = 65_535
BINS = 64
#: Pixels of a frame or canvas; what a file says beyond that is taken for a fault, since it fits no task's memory.
MAX_PIXELS = 1 << 24
#: Bytes of files or payloads that a task handles together.
TOGETHER = 1 << 20

FRAME = (
    "struct<frame:int,delay_ms:int,left:int,top:int,width:int,height:int,disposal:int,transparent:int,"
    "samples:binary,rgb:binary,histogram:array<bigint>>"
)
DECODED = f"struct<width:int,height:int,loops:int,error:string,frames:array<{FRAME}>>"


def _widths(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and the bit at which each begins."""
    first = (1 << bits) + 2
    k = np.arange(1 << 16)
    size = np.minimum(first + np.maximum(k - 1, 0), 4095)
    w = np.maximum(np.floor(np.log2(size)).astype(np.int64) + 1, bits + 1)
    return w, np.concatenate([[0], np.cumsum(w)])


_W8 = _widths(8)


def _runs(data: bytes) -> list[list[int]]:
    """The codes of 8-bit samples, a list for each table: a new one begins when the last is full. Codes are held times 256."""
    runs: list[list[int]] = []
    run: list[int] = []
    rest = iter(data)
    p = next(rest, -1) << 8
    if p < 0:
        return [run]
    table: dict[int, int] = {}
    nxt = 258 << 8
    for c in rest:
        if (k := p + c) in table:
            p = table[k]
        else:
            run.append(p)
            table[k] = nxt
            nxt += 256
            p = c << 8
            if nxt == 4096 << 8:
                runs.append(run)
                table, nxt, run = {}, 258 << 8, []
    run.append(p)
    return [*runs, run]


def lzw_encode(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples; the table starts anew when it is full."""
    out: list[int] = []
    for run in _runs(data):
        out.append(256 << 8)
        out += run
    out.append(257 << 8)
    codes = np.array(out, np.int64) >> 8
    clears = np.flatnonzero(codes == 256)
    since = np.arange(len(codes)) - np.repeat(clears, np.diff(np.concatenate([clears, [len(codes)]])))
    width = np.where(since == 0, 0, _W8[0][np.maximum(since - 1, 0)])
    width[0] = 9
    later = clears[1:]  # a clear code is as wide as the code in its place would be
    width[later] = _W8[0][np.diff(clears) - 1]
    return _pack(codes, width)


def _pack(codes: np.ndarray, width: np.ndarray) -> bytes:
    ends = np.cumsum(width)
    at = ends - width
    n = int(ends[-1] + 7) // 8
    value = codes << (at & 7)
    byte = at >> 3
    out = np.zeros(n + 3)
    for j in range(3):
        out += np.bincount(byte + j, (value >> (8 * j)) & 255, minlength=n + 3)[: n + 3]
    return out[:n].astype(np.uint8).tobytes()


def _read_codes(stream: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a stream without clear and end codes, and of each the code before the one that made its entry; -1 for literals."""
    if not 2 <= bits <= 8:
        raise ValueError(f"a code size of {bits}")
    w, starts = _W8 if bits == 8 else _widths(bits)
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, count = 8 * len(stream), 0, 0
    found, parents = [], []
    while at < total:
        left = int(np.searchsorted(starts, total - at, side="right")) - 1  # whole codes
        for n in (min(left, 4096), left):  # most tables are cleared when they are full
            pos = at + starts[:n]
            byte = pos >> 3
            word = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
            every = (word >> (pos & 7)) & ((1 << w[:n]) - 1)
            stop = np.flatnonzero((every == clear) | (every == end))
            if len(stop):
                break
        cut = int(stop[0]) if len(stop) else n
        codes = every[:cut]
        parent = np.where(codes < clear, -1, codes - (clear + 2))
        if (parent >= np.arange(cut)).any():
            raise ValueError("a code before its entry")
        found.append(codes)
        parents.append(np.where(parent < 0, -1, parent + count))
        count += cut
        if not len(stop) and n == len(w):
            raise ValueError("a code stream without a clear code")
        if not len(stop) or every[cut] == end:
            break
        at += int(starts[cut + 1])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *parents])


def lzw_decode_many(streams: list[tuple[bytes, int, int]]) -> list[bytes | ValueError]:
    """The samples of code streams, each with the bits at which its table starts and the samples that are wanted of it at most.

    What a code stands for is what its parent does and one sample more, the first of the code behind the parent. All streams are
    spelt together, from the last sample of each code backwards: step i writes the i-th last sample of the codes that have one.
    """
    out: list[bytes | ValueError] = []
    codes, parents, counts, base = [], [], [], 0
    for stream, bits, _ in streams:
        try:
            c, p = _read_codes(stream, bits)
        except ValueError as e:
            out.append(e)
            c = p = np.zeros(0, np.int64)
        else:
            out.append(b"")
        codes.append(c)
        parents.append(np.where(p < 0, -1, p + base))
        counts.append(len(c))
        base += len(c)
    if not base:
        return out
    code, parent = np.concatenate(codes), np.concatenate(parents)
    literal = parent < 0
    root = np.where(literal, np.arange(base), parent)
    length = np.where(literal, 0, 1)  # steps to the root, doubled with each jump
    while (more := length[root]).any():
        length += more
        root = root[root]
    length += 1
    # no more than is wanted of a stream: that much memory is known to be bounded
    cut = []
    for lo, n, (_, _, most) in zip(np.cumsum(counts) - counts, counts, streams):
        cut.append(min(n, int(np.searchsorted(np.cumsum(length[lo : lo + n]), most)) + 1))
    shown = np.concatenate([np.arange(lo, lo + n) for lo, n in zip(np.cumsum(counts) - counts, cut)])
    ends = np.cumsum(length[shown])
    first = code[root].astype(np.uint8)
    made = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    of, place = shown, ends - 1
    while len(of):
        up = parent[of]
        made[place] = np.where(up < 0, code[of], first[np.minimum(up + 1, base - 1)])
        left = up >= 0
        of, place = up[left], place[left] - 1
    whole = made.tobytes()
    at = done = 0
    for i, n in enumerate(cut):
        done += n
        upto = int(ends[done - 1]) if done else 0
        if not isinstance(out[i], ValueError):
            out[i] = whole[at:upto]
        at = upto
    return out


def lzw_decode(stream: bytes, bits: int) -> bytes:
    """The samples of an LZW code stream with a table that starts at `bits` bits."""
    (got,) = lzw_decode_many([(stream, bits, 1 << 40)])
    if isinstance(got, ValueError):
        raise got
    return got


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


_GREY = bytes(v for i in range(256) for v in (i, i, i))
#: Sample i as a colour: its six high bits are the two high bits of red, green and blue, so each histogram bin has four samples.
SPREAD = bytes(v for i in range(256) for v in ((i >> 6) * 64 + (i & 3) * 16, (i >> 4 & 3) * 64 + (i & 3) * 16, (i >> 2 & 3) * 64 + (i & 3) * 16))


def encode_payload(payload: bytes, width: int = WIDTH, delay_ms: int = 100) -> bytes:
    """A GIF whose samples, frame after frame, are the payload; its length has to be a multiple of width."""
    rows = max(1, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, MAX_ROWS), 0xF7, 0, 0), SPREAD]
    for top in range(0, rows, MAX_ROWS):
        part = payload[top * width : (top + MAX_ROWS) * width]
        out += [
            b"\x21\xf9\x04\x04" + struct.pack("<H", delay_ms // 10) + b"\0\0",
            b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0),
            b"\x08",
            _blocks(lzw_encode(part)),
        ]
    return b"".join([*out, b"\x3b"])


def _sub_blocks(b: bytes, i: int) -> tuple[bytes, int]:
    parts = []
    while i < len(b) and b[i]:
        parts.append(b[i + 1 : i + 1 + b[i]])
        i += 1 + b[i]
    return b"".join(parts), i + 1


def _palette(b: bytes, at: int, flags: int) -> np.ndarray:
    """256 colours as 0xRRGGBB; those that the file doesn't have are black."""
    n = 2 << (flags & 7)
    rgb = np.frombuffer(b, np.uint8, 3 * n, at).reshape(n, 3).astype(np.uint32)
    return np.concatenate([rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2], np.zeros(256 - n, np.uint32)])


_DEFAULT = _palette(_GREY, 0, 7)


def _parse(b: bytes) -> dict:
    """The blocks of a GIF: sizes, loops, an error if any, and what describes each frame before its code stream is read."""
    out: dict = {"width": 0, "height": 0, "loops": None, "error": None, "back": 0, "specs": []}
    try:
        if b[:6] not in (b"GIF89a", b"GIF87a"):
            raise ValueError("no GIF header")
        width, height, flags, back, _ = struct.unpack_from("<HHBBB", b, 6)
        out |= {"width": width, "height": height}
        i, palette = 13, None
        if flags & 0x80:
            palette = _palette(b, i, flags)
            i += 3 * (2 << (flags & 7))
            out["back"] = int(palette[back])
        control = (0, 0, None)
        while b[i] != 0x3B:
            if b[i] == 0x21:
                label = b[i + 1]
                data, nxt = _sub_blocks(b, i + 2)
                if label == 0xF9:
                    f, delay, clear = struct.unpack("<BHB", data[:4])
                    control = (f >> 2 & 7, delay * 10, clear if f & 1 else None)
                elif label == 0xFF and data[:11] == b"NETSCAPE2.0" and data[11:12] == b"\x01":
                    out["loops"] = struct.unpack("<H", data[12:14])[0]
                i = nxt
                continue
            if b[i] != 0x2C:
                raise ValueError(f"unknown block {b[i]:#x}")
            box = struct.unpack_from("<HHHH", b, i + 1)
            f = b[i + 9]
            i += 10
            colours = palette
            if f & 0x80:
                colours = _palette(b, i, f)
                i += 3 * (2 << (f & 7))
            bits = b[i]
            data, i = _sub_blocks(b, i + 1)
            if box[2] * box[3] > MAX_PIXELS:
                raise ValueError(f"a frame of {box[2]} x {box[3]}")
            out["specs"].append((box, bool(f & 0x40), _DEFAULT if colours is None else colours, control, bits, data))
            control = (0, 0, None)
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = str(e) or type(e).__name__
    return out


def _frames(told: dict, streams: list[bytes | ValueError]) -> dict:
    """Each frame's samples, histogram and composed canvas; those before a fault, and the fault."""
    width, height = told["width"], told["height"]
    out = {"width": width, "height": height, "loops": told["loops"], "error": told["error"], "frames": []}
    canvas = undo = None  # undo: what the last frame's disposal asks for
    if told["specs"] and width * height <= MAX_PIXELS:
        canvas = np.zeros((height, width), np.uint32)
    elif told["specs"]:
        out["error"] = f"a canvas of {width} x {height}"
    for k, (((left, top, w, h), laced, colours, (disposal, delay, clear), _, _), got) in enumerate(zip(told["specs"], streams)):
        if isinstance(got, ValueError) or len(got) < w * h:
            out["error"] = str(got) if isinstance(got, ValueError) else "too few samples"
            break
        samples = np.frombuffer(got, np.uint8, w * h).reshape(h, w)
        if laced:  # rows 0, 8, ...; 4, 12, ...; 2, 6, ...; 1, 3, ...
            plain = np.empty_like(samples)
            plain[np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])] = samples
            samples = plain
        counts = np.bincount(samples.ravel(), minlength=256)
        if clear is not None:
            counts[clear] = 0
        bins = (colours >> 22 & 3) << 4 | (colours >> 14 & 3) << 2 | (colours >> 6 & 3)
        composed = None
        if canvas is not None:
            canvas = canvas if undo is None else undo
            undo = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            shown = samples[: part.shape[0], : part.shape[1]]
            part[...] = colours[shown] if clear is None else np.where(shown == clear, part, colours[shown])
            composed = canvas.astype(">u4").view(np.uint8).reshape(height, width, 4)[:, :, 1:].tobytes()
            if disposal == 2:
                undo = canvas.copy()
                undo[top : top + h, left : left + w] = told["back"] if clear is None else 0
        out["frames"].append(
            {"frame": k, "delay_ms": delay, "left": left, "top": top, "width": w, "height": h, "disposal": disposal, "transparent": clear,
             "samples": samples.tobytes(), "rgb": composed, "histogram": np.bincount(bins, counts, minlength=BINS).astype(np.int64)}
        )
    return out


def decode_many(files: list[bytes]) -> list[dict]:
    """Frames of GIFs: samples (palette indices), the composed RGB canvas, and a histogram.

    The histogram counts the frame's own pixels, transparent ones left out, by colour: two bits each of red, green and blue.
    A truncated or malformed file gives the frames before the fault and an error; so does one with a frame of more than MAX_PIXELS.
    A canvas of more has an error and frames without rgb.
    """
    told = [_parse(b) for b in files]
    got = iter(lzw_decode_many([(data, bits, box[2] * box[3]) for t in told for box, _, _, _, bits, data in t["specs"]]))
    return [_frames(t, [next(got) for _ in t["specs"]]) for t in told]


def decode(b: bytes) -> dict:
    return decode_many([b])[0]


def payload_of(text: Column, width: int = WIDTH) -> Column:
    """The UTF-8 bytes of a text, zero bytes appended up to a positive multiple of width; null counts as empty."""
    raw = F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")
    size = F.greatest(F.ceil(F.octet_length(raw) / width), F.lit(1)) * width
    return F.rpad(raw, size.cast("int"), F.lit(b"\0"))


def encode_gif(payload: Column) -> Column:
    """Payload bytes as a GIF of 64 columns; null stays null."""

    @F.pandas_udf("binary")
    def of(col: pd.Series) -> pd.Series:
        return col.map(lambda p: None if p is None else encode_payload(bytes(p)))

    return of(payload)


def _together(values: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of values that hold about TOGETHER bytes."""
    some, size = [], 0
    for v in values:
        some.append(v)
        size += len(v)
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def decode_gif(media: Column) -> Column:
    """GIF bytes as DECODED: size, loops, error and timed frames. Null gives a null; see decode_many() for faulty files."""

    @F.pandas_udf(DECODED)
    def of(col: pd.Series) -> pd.DataFrame:
        read = (row for some in _together(bytes(m) for m in col if m is not None) for row in decode_many(some))
        none = {"width": None, "height": None, "loops": None, "error": "null", "frames": []}
        rows = [none if m is None else next(read) for m in col]
        return pd.DataFrame(rows, columns=["width", "height", "loops", "error", "frames"]).astype({"width": "Int32", "height": "Int32", "loops": "Int32"})

    return of(media)


STORED = "struct<media:binary,payload:binary,rows:array<int>,delays:array<int>,histogram:array<bigint>,rgb_crc32:bigint>"


def store(payload: Column) -> Column:
    """STORED: a payload as GIF bytes, and what its frames hold once these are read back: all samples, rows and delays of each frame, the
    sum of their histograms, and a checksum of their composed canvases. encode_gif and decode_gif in one pass, without the canvases."""

    @F.pandas_udf(STORED)
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for col in parts:
            for some in _together(map(bytes, col)):
                media = [encode_payload(p) for p in some]
                rows = []
                for m, told in zip(media, decode_many(media)):
                    frames = told["frames"]
                    crc = 0
                    for f in frames:
                        crc = crc32(f["rgb"], crc)
                    hist = sum((f["histogram"] for f in frames), np.zeros(BINS, np.int64))
                    rows.append((m, b"".join(f["samples"] for f in frames), [f["height"] for f in frames], [f["delay_ms"] for f in frames], hist, crc))
                yield pd.DataFrame(rows, columns=["media", "payload", "rows", "delays", "histogram", "rgb_crc32"])

    return of(payload)


def media_digests(docs: DataFrame) -> DataFrame:
    """Every text stored as a GIF and read back, one row per document.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (number of frames, their rows,
    the checksum of the composed canvases, and the colour histogram). Null texts are empty; texts of any length are whole, in as
    many frames as they need; repeated rows each give a row; an empty table none; other columns are ignored.
    """
    text = F.col("text").cast("string")
    stored = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), store(payload_of(text)).alias("s"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("s.payload").cast("long").alias("payload_bytes"),
        F.sha2("s.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("s.payload", -WIDTH, WIDTH)).alias("tail_crc32"),
        F.octet_length("s.media").cast("long").alias("media_bytes"),
        F.sha2("s.media", 256).alias("media_sha256"),
        F.concat(
            F.lit("frames="), F.size("s.rows").cast("string"),
            F.lit(";rows="), F.array_join(F.transform("s.rows", lambda r: r.cast("string")), ","),
            F.lit(";rgb="), F.col("s.rgb_crc32").cast("string"),
            F.lit(";hist="), F.array_join(F.transform("s.histogram", lambda h: h.cast("string")), ","),
        ).alias("feature"),
    )
