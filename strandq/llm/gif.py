"""GIF media columns: LZW code streams, palettes, transparency, disposal, and timed frames with colour histograms."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The canvas: WIDE samples a row, at most ROWS rows a frame.  PIXELS is the unit of payloads.
WIDE, ROWS, PIXELS = 24, 96, 576
#: The sample for which a pixel that shows nothing stands: a blank.
BLANK = 32
#: Canvases of more pixels are an error: memory holds two of them.
MOST = 1 << 26
#: What happens to each frame, in turn, before the next: back to nothing, back to what was there, or left.
DISPOSALS = (2, 3, 2, 1)


@dataclass
class Frame:
    """rgba: the whole canvas while the frame shows; delay in hundredths of a second; left, top, width, height: what was drawn."""

    delay: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    rgba: np.ndarray


@lru_cache(maxsize=64)
def _widths(depth: int, n: int) -> np.ndarray:
    """Bits of the n codes that follow a clear code: a code's width depends on its number alone."""
    size = (1 << depth) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(12, np.floor(np.log2(size)).astype(np.int64) + 1)


#: The entry of each entry with a byte behind it, 0 for none, all 0 between calls.  The tasks of a worker come one after another.
_TABLE: list[int] = []


def lzw_codes(data: bytes, depth: int) -> np.ndarray:
    """The longest known stretch after another, between a clear code and an end code; the table is cleared when its 4096 entries are used.

    Codes are kept times 2**depth, so that a code and the next byte, of fewer than 2**depth, are a place in the table without a shift."""
    if not _TABLE:
        _TABLE.extend([0] * (4096 << 8))
    one, clear = 1 << depth, 1 << 2 * depth
    first = clear + 2 * one
    codes, places, table, fresh = [clear], [], _TABLE, first
    put, used, full = codes.append, places.append, 4096 << depth
    at = data[0] << depth if data else clear + one
    for b in data[1:]:
        place = at | b
        if code := table[place]:
            at = code
            continue
        put(at)
        used(place)
        table[place] = fresh
        at = b << depth
        fresh += one
        if fresh > full:
            put(clear)
            for place in places:
                table[place] = 0
            places.clear()
            fresh = first
    for place in places:
        table[place] = 0
    put(at)
    if data:
        put(clear + one)
    return np.array(codes) >> depth


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """The codes of data packed at their widths, all at once: no two codes share a bit, so that bytes are sums."""
    codes = lzw_codes(data, depth)
    number = np.arange(len(codes))
    since = np.maximum.accumulate(np.where(codes == 1 << depth, number + 1, 0))
    nth = np.append(0, number[1:] - since[:-1])  # of a code behind the last clear code
    width = _widths(depth, 4352)[nth]
    bit = np.cumsum(width) - width
    at, value = bit >> 3, codes << (bit & 7)
    size = int(bit[-1] + width[-1] + 7) >> 3
    return sum(np.bincount(at + k, value >> 8 * k & 255, size + 3) for k in range(3)).astype(np.uint8)[:size].tobytes()


def lzw_decode(data: bytes, depth: int, pixels: int) -> bytes:
    """The inverse of lzw_encode, for any stream of codes.

    Code k behind a clear code makes an entry of its own stretch of the output and the pixel that follows.  So a pixel is
    a literal or that of an earlier place; what it is in the end is found for all pixels at once by doubling the steps.
    """
    clear, first = 1 << depth, (1 << depth) + 2
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    windows = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    total, bit, out, done, ended = len(data) * 8, 0, [], 0, False
    while done < pixels and not ended:  # from one clear code to the next
        some, n = [], 0
        while True:
            width = _widths(depth, n + 1024)[n:]
            end = bit + np.cumsum(width)
            have = int(np.searchsorted(end, total, side="right"))
            pos = end[:have] - width[:have]
            codes = windows[pos >> 3] >> (pos & 7).astype(np.uint32) & ((1 << width[:have]) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes >= clear) & (codes < first))
            cut = int(stop[0]) if len(stop) else have
            some.append(codes[:cut].astype(np.int64))
            n += cut
            if cut < have or have < 1024:
                ended = cut == have or int(codes[cut]) != clear
                bit = int(end[min(cut, have - 1)]) if have else total
                break
            bit = int(end[-1])
            if n > pixels + 1024:  # more codes than pixels: what follows doesn't show
                ended = True
                break
        codes = np.concatenate(some)
        if len(codes):
            out.append(_stretch(codes, clear, first, pixels - done))
            done += len(out[-1])
    return np.concatenate(out)[:pixels].tobytes() if out else b""


def _stretch(codes: np.ndarray, clear: int, first: int, most: int) -> np.ndarray:
    """The pixels of codes without clear codes among them, at least `most` of them if there are."""
    number = np.arange(len(codes))
    parent = np.where(codes < clear, number, codes - first)  # the code whose entry this is; a literal's own number
    if (parent > number - (codes >= clear)).any():
        raise ValueError("code beyond the table")
    size, step = (codes >= clear).astype(np.int64), parent
    while ((further := step[step]) != step).any():  # a code is one longer than its parent
        size, step = size + size[step], further
    start = np.cumsum(size + 1) - size - 1
    count = int(np.searchsorted(start, most))
    size, start, parent = size[:count] + 1, start[:count], parent[:count]
    source = np.arange(int(start[-1] + size[-1])) - np.repeat(start - start[parent], size)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.zeros(len(source), np.uint8)
    value[start] = np.minimum(codes[:count], clear - 1)  # where it isn't a literal, no source leads to it
    return value[source]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


@lru_cache(maxsize=256)
def _passes(high: int) -> np.ndarray:
    """The rows of an interlaced image in the order in which they are stored."""
    return np.array([r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, high, step)])


def encode_gif(payload: bytes) -> bytes:
    """Payload as frames of up to ROWS rows of WIDE grey samples, each shown a hundredth of a second per row.

    The palette holds the samples that occur.  A frame draws the rows between the first and the last that must change;
    within them, what the canvas shows already (a blank where it shows nothing) is transparent, if the palette has an
    index to spare.  So what a frame shows depends on how the ones before it were disposed of.  Every other frame is
    interlaced.  The length must be a positive multiple of 576.
    """
    if not payload or len(payload) % PIXELS:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    data = np.frombuffer(payload, np.uint8)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    depth = min(8, max(2, len(used).bit_length()))
    clear = len(used) if len(used) < 1 << depth else None
    grey, index = np.zeros(1 << depth, np.uint8), np.zeros(256, np.uint8)
    grey[: len(used)], index[used] = used, np.arange(len(used))
    size = ROWS * WIDE
    shown = np.full(min(size, len(data)), BLANK, np.uint8)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDE, len(shown) // WIDE, 0xF0 | (depth - 1), 0, 0), np.repeat(grey, 3).tobytes()]
    for k, at in enumerate(range(0, len(data), size)):
        new = data[at : at + size]
        before = shown[: len(new)]
        change = np.flatnonzero(new != before)
        a, b = (change[0] // WIDE * WIDE, (change[-1] // WIDE + 1) * WIDE) if len(change) else (0, WIDE)
        drawn = index[new[a:b]]
        if clear is not None:
            drawn[new[a:b] == before[a:b]] = clear
        if k & 1:
            drawn = drawn.reshape(-1, WIDE)[_passes((b - a) // WIDE)]
        dispose = DISPOSALS[k % len(DISPOSALS)]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", dispose << 2 | (clear is not None), len(new) // WIDE, clear or 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHBB", 0, a // WIDE, WIDE, (b - a) // WIDE, (k & 1) << 6, depth))
        out.append(_blocks(lzw_encode(drawn.tobytes(), depth)))
        if dispose == 1:
            before[:] = new
        elif dispose == 2:
            before[a:b] = BLANK
    return b"".join([*out, b"\x3b"])


def samples(frame: Frame) -> bytes:
    """The samples that a frame of encode_gif shows."""
    rows = frame.rgba[: frame.delay]
    return np.where(rows[..., 3] > 0, rows[..., 0], BLANK).astype(np.uint8).tobytes()


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order, composed on a canvas by the rules of disposal, transparency and interlacing; ValueError if the data end
    early, are none, or have a canvas of more than MOST pixels."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    try:
        yield from _frames(data)
    except (IndexError, struct.error):
        raise ValueError("the data end early") from None


def _palette(data: bytes, at: int, flags: int) -> np.ndarray:
    """Opaque colours."""
    colours = np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), at).reshape(-1, 3)
    return np.concatenate([colours, np.full((len(colours), 1), 255, np.uint8)], axis=1)


def _frames(data: bytes) -> Iterator[Frame]:
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    if wide * high > MOST:
        raise ValueError("the canvas is too large")
    at, shared = 13, None
    if flags & 0x80:
        shared = _palette(data, at, flags)
        at += 3 << ((flags & 7) + 1)
    canvas = np.zeros((high, wide, 4), np.uint8)
    delay, clear, dispose = 0, None, 0
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", data, at + 3)
                dispose, clear = bits >> 2 & 7, index if bits & 1 else None
            at += 2
            while n := data[at]:
                at += n + 1
            at += 1
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        x, y, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if bits & 0x80:
            palette = _palette(data, at, bits)
            at += 3 << ((bits & 7) + 1)
        depth, codes, at = data[at], [], at + 1
        if not 1 <= depth <= 8:
            raise ValueError("unknown code size")
        while n := data[at]:
            codes.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        indices = lzw_decode(b"".join(codes), depth, w * h)
        if len(indices) < w * h:
            raise ValueError("the data end early")
        if palette is None:
            raise ValueError("no palette")
        grid = np.frombuffer(indices, np.uint8).reshape(h, w)
        if bits & 0x40:
            grid = grid[np.argsort(_passes(h))]
        before = canvas.copy() if dispose == 3 else None
        view = canvas[y : y + h, x : x + w]
        shown = grid[: view.shape[0], : view.shape[1]]
        if clear is None:
            view[:] = np.take(palette, shown, axis=0, mode="clip")
        else:
            seen = shown != clear
            view[seen] = np.take(palette, shown[seen], axis=0, mode="clip")
        yield Frame(delay, x, y, w, h, dispose, canvas.copy())
        if dispose == 2:
            view[:] = 0
        elif dispose == 3:
            canvas = before
        delay, clear, dispose = 0, None, 0


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Visible pixels per cell of 64 colours, four of each of red, green and blue."""
    high = rgba >> 6
    cell = high[..., 0] << 4 | high[..., 1] << 2 | high[..., 2]
    return np.bincount(cell[rgba[..., 3] > 0], minlength=64)


def to_payload(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes padded with 255 to a positive multiple of 576."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % PIXELS if raw else PIXELS)


def gif_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a GIF) for each row of docs (doc_id, text); null texts count as empty, further columns don't matter.

    Repeated rows and rows without id come back each; an empty table gives an empty result.  A text of any length is one GIF.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 256):
                some = part.iloc[i : i + 256]
                made = [(n, encode_gif(p)) for n, p in map(to_payload, some["text"])]
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64").array, "n_bytes": [n for n, _ in made], "media": [m for _, m in made]})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


FRAME = "struct<delay:int,left:int,top:int,width:int,height:int,disposal:int,histogram:array<int>>"


def gif_columns(media: DataFrame) -> DataFrame:
    """Per row of media (doc_id, n_bytes, media): frames (timed, with the rectangle drawn and a histogram of 64 colours
    of the composed canvas), the length and digests of the samples that they show, and digests of the GIF.

    Broken media give the frames before the break and an error; null media give no frames.  Frames are read one after
    another, so that memory holds one canvas; an empty table gives an empty result.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, numbers = ([], [], []), ([], [], [])  # payload and media digests, errors; payload size, tail, media size
            fields, colours, offsets = [], [], [0]
            for data in batch.column(2).to_pylist():
                digest, size, tail, error = sha256(), 0, b"", None
                try:
                    for f in decode_gif(data) if data is not None else ():
                        own = samples(f)
                        digest.update(own)
                        size, tail = size + len(own), (tail + own)[-32:]
                        fields.append((f.delay, f.left, f.top, f.width, f.height, f.disposal))
                        colours.append(histogram(f.rgba))
                except ValueError as e:
                    error = str(e)
                offsets.append(len(fields))
                data = data or b""
                for column, value in zip((*texts, *numbers), (digest.hexdigest(), sha256(data).hexdigest(), error, size, zlib.crc32(tail), len(data)), strict=True):
                    column.append(value)
            of = np.array(fields, np.int32).reshape(-1, 6)
            histograms = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * 64), pa.array(np.array(colours, np.int32).reshape(-1)))
            frames = pa.StructArray.from_arrays([*(pa.array(of[:, k]) for k in range(6)), histograms], ["delay", "left", "top", "width", "height", "disposal", "histogram"])
            yield pa.record_batch({
                "doc_id": batch.column(0), "n_bytes": batch.column(1), "payload_bytes": pa.array(numbers[0], pa.int64()), "payload_sha256": pa.array(texts[0], pa.string()),
                "tail_crc32": pa.array(numbers[1], pa.int64()), "media_bytes": pa.array(numbers[2], pa.int64()), "media_sha256": pa.array(texts[1], pa.string()),
                "frames": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), frames), "error": pa.array(texts[2], pa.string())})

    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<{FRAME}>, error string"
    return media.selectExpr("cast(doc_id as bigint) doc_id", "cast(n_bytes as bigint) n_bytes", "media").mapInArrow(run, schema)


def gif_frames(columns: DataFrame) -> DataFrame:
    """doc_id, frame, and the fields of each frame of gif_columns."""
    return columns.select("doc_id", F.posexplode("frames").alias("frame", "f")).select("doc_id", "frame", "f.*")


def feature(frames: Column) -> Column:
    """Frames, whole duration, rows drawn, and the counts of the colours that occur, as text."""
    total = lambda name: F.aggregate(frames, F.lit(0).cast("long"), lambda a, f: a + f[name])
    counts = F.aggregate(frames, F.array_repeat(F.lit(0).cast("long"), 64), lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    seen = F.filter(F.transform(counts, lambda n, i: F.when(n > 0, F.concat_ws(":", i, n))), lambda x: x.isNotNull())
    return F.concat(F.lit("frames="), F.size(frames), F.lit(";time="), total("delay"), F.lit(";drawn="), total("height"), F.lit(";colours="), F.array_join(seen, ","))
