"""Media columns: MPEG audio streams that carry bytes without loss, and their parser.

``store`` writes, per row, an ID3v2 tag (with the payload's size), a frame with a table of the variable bit rate, and
checksummed Layer III frames of silence at 48 kHz whose ancillary data are the payload; every frame has the smallest
bit rate that holds what is left. ``parse`` reads any such column: it skips tags at either end, looks for frame headers
again after rubbish (a candidate counts when its checksum holds, or another header, a tag or the end follows where its length says), checks each
frame's CRC-16, reads Xing/Info tables, and returns the exact duration as samples, the seek offset of each frame, the
ancillary payload and counts of what it met.

Null texts count as empty; empty media give no frames and an empty payload; media without any frame give zeros.
Equal texts give equal media. Only the named columns are read, whatever other columns are called.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.textkit import clean, lists, slices, tidy

# Fixed values of the format: bit rates (kbit/s) by index for MPEG-1 and MPEG-2/2.5, layers I to III; sample rates.
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {3: 1, 2: 2, 0: 2.5}

UNIT = 64
_CRC_TABLE = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1) ^ 0x8005 if _c & 0x8000 else _c << 1
    _CRC_TABLE.append(_c & 0xFFFF)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for b in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC_TABLE[(crc >> 8) ^ b]
    return crc


class Header:
    """A frame header, or None in ``size`` where the four bytes are none."""

    __slots__ = ("channels", "checked", "kbps", "layer", "samples", "side", "size", "sample_rate", "version")

    def __init__(self, word: int):
        self.size = None
        version, layer = VERSIONS.get(word >> 19 & 3), 4 - (word >> 17 & 3)
        rate, sampling = word >> 12 & 15, word >> 10 & 3
        if word >> 21 != 0x7FF or version is None or layer == 4 or rate in (0, 15) or sampling == 3 or word & 3 == 2:
            return
        self.version, self.layer = version, layer
        self.kbps, self.sample_rate = RATES[1 if version == 1 else 2, layer][rate], SAMPLE_RATES[version][sampling]
        self.checked = not word >> 16 & 1
        self.channels = 1 if word >> 6 & 3 == 3 else 2
        padding = word >> 9 & 1
        self.samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
        if layer == 1:
            self.size = (12_000 * self.kbps // self.sample_rate + padding) * 4
        else:
            self.size = self.samples * 125 * self.kbps // self.sample_rate + padding
        self.side = 0 if layer != 3 else (17 if self.channels == 1 else 32) if version == 1 else (9 if self.channels == 1 else 17)


_headers: dict[int, Header] = {}
_checksums: dict[bytes, int] = {}


def header(data: bytes, at: int) -> Header | None:
    if at + 4 > len(data) or data[at] != 0xFF:
        return None
    word = int.from_bytes(data[at : at + 4], "big")
    if (h := _headers.get(word)) is None:
        if len(_headers) > 100_000:
            _headers.clear()
        h = _headers[word] = Header(word)
    return h if h.size else None


def checksum(covered: bytes) -> int:
    """CRC-16 of what a Layer III frame's checksum covers; such strings repeat, so that they are kept."""
    if (c := _checksums.get(covered)) is None:
        if len(_checksums) > 100_000:
            _checksums.clear()
        c = _checksums[covered] = crc16(covered)
    return c


# --- writing ---------------------------------------------------------------------------------------------------------

_OVERHEAD = 4 + 2 + 17  # header, checksum, side information of one channel
_SIZES = [3 * k for k in RATES[1, 3]]  # at 48 kHz, 1152 samples: 3 bytes per kbit/s, never padded


def _head(rate: int) -> bytes:
    """MPEG-1, Layer III, checksummed, 48 kHz, one channel, with an empty side information."""
    front = bytes((0xFF, 0xFA, rate << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    return front + struct.pack(">H", crc16(front[2:] + side)) + side


_HEADS = [b""] + [_head(r) for r in range(1, 15)]


def _tag(size: int) -> bytes:
    body = b"\x00payload\x00" + str(size).encode()
    frame = b"TXXX" + struct.pack(">IH", len(body), 0) + body
    n = len(frame)
    return b"ID3\x03\x00\x00" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + frame


def write(payload: bytes) -> bytes:
    """A stream whose ancillary data are the payload."""
    largest, room = len(_SIZES) - 1, _SIZES[-1] - _OVERHEAD
    full, rest = divmod(len(payload), room)
    frames = [_HEADS[largest] + payload[i * room : (i + 1) * room] for i in range(full)]
    if rest:
        rate = next(r for r in range(1, 15) if _SIZES[r] - _OVERHEAD >= rest)
        frames.append((_HEADS[rate] + payload[full * room :]).ljust(_SIZES[rate], b"\x00"))
    total = sum(map(len, frames))
    ends = np.cumsum([0, *map(len, frames)])
    places = ends[(np.arange(100) * len(frames)) // 100] if frames else np.zeros(100, np.int64)
    table = bytes((places * 256 // max(total, 1)).clip(0, 255).astype(np.uint8))
    first_rate = 6  # 240 bytes: the table fits
    info = _HEADS[first_rate] + b"Xing" + struct.pack(">III", 7, len(frames), total) + table
    return _tag(len(payload)) + info.ljust(_SIZES[first_rate], b"\x00") + b"".join(frames)


# --- reading ---------------------------------------------------------------------------------------------------------


def _leading_tags(data: bytes) -> tuple[int, int | None, int]:
    """Where the tags at the start end, the payload's size if a tag has it, the number of tags."""
    at, size, n = 0, None, 0
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        length = (data[at + 6] & 127) << 21 | (data[at + 7] & 127) << 14 | (data[at + 8] & 127) << 7 | data[at + 9] & 127
        end, p = at + 10 + length, at + 10
        while p + 10 <= min(end, len(data)) and data[p] != 0:
            length = int.from_bytes(data[p + 4 : p + 8], "big")
            if data[p : p + 4] == b"TXXX":
                name, _, value = data[p + 11 : p + 10 + length].partition(b"\x00")
                if name == b"payload" and value.isdigit():
                    size = int(value)
            p += 10 + length
        at, n = end + 10 * (data[at + 5] >> 4 & 1), n + 1
    return min(at, len(data)), size, n


def _trailing_tag(data: bytes, at: int) -> int:
    """The length of a tag that begins here, behind the last frame, or 0."""
    if data.startswith(b"TAG", at) and at + 128 == len(data):
        return 128
    if data.startswith(b"APETAGEX", at) and at + 32 <= len(data):
        return min(32 + int.from_bytes(data[at + 12 : at + 16], "little"), len(data) - at)
    return 0


def _sound(data: bytes, at: int, h: Header) -> bool:
    """Whether a Layer III frame's checksum holds."""
    return checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6], "big")


def read(data: bytes) -> dict:
    """Everything that a stream tells; see ``SCHEMA``."""
    at, size, tags = _leading_tags(data)
    end = len(data)
    offsets, parts, rates = [], [], []
    samples = bad = skipped = xing_frames = toc = 0
    sample_rate, first, skipped_last = None, True, True
    while at + 4 <= end:
        h = header(data, at)
        ok = h is not None and at + h.size <= end
        if ok and skipped_last:
            follows = at + h.size
            ok = follows == end or header(data, follows) is not None or _trailing_tag(data, follows) > 0 or (h.checked and h.layer == 3 and _sound(data, at, h))
        if not ok and (length := _trailing_tag(data, at)):
            at, tags = at + length, tags + 1
            continue
        if not ok:
            skipped_last = True
            found = data.find(b"\xff", at + 1, end)
            skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        skipped_last = False
        sample_rate = sample_rate or h.sample_rate
        body = at + 4 + 2 * h.checked + h.side
        if h.checked and h.layer == 3 and not _sound(data, at, h):
            bad += 1
        if first and data[body : body + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
            if flags & 1:
                xing_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                p += 4
            if flags & 4:
                toc = crc16(data[p : p + 100])
        else:
            offsets.append(at)
            parts.append(data[body : at + h.size])
            rates.append(h.kbps)
            samples += h.samples
        first = False
        at += h.size
    payload = b"".join(parts)
    return {
        "payload": payload if size is None else payload[:size], "n_frames": len(offsets), "samples": samples, "sample_rate": sample_rate or 0,
        "bad_checksums": bad, "skipped_bytes": skipped, "tags": tags, "table_frames": xing_frames, "table_crc": toc, "max_kbps": max(rates, default=0),
        "sum_kbps": sum(rates), "seek_offsets": offsets,
    }


FIELDS = "payload binary, n_frames int, samples long, sample_rate int, bad_checksums int, skipped_bytes long, tags int, table_frames int, table_crc int, max_kbps int, sum_kbps long"
SCHEMA = f"{FIELDS}, seek_offsets array<long>"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """Per row: the id, the text's bytes (``n_bytes``), and the stream (``media``) of the text padded by zeros to a positive multiple of ``unit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, offsets in slices(batch):
                data, sizes = flat.tobytes(), np.diff(offsets)
                texts = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                media = [write(t.ljust(max(1, -(-len(t) // unit)) * unit, b"\x00")) for t in texts]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = clean(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def parse(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the kept columns, the stream, and all that ``read`` finds in it."""
    names = [*keep, media_col]
    fields = SCHEMA.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [read(x or b"") for x in part.column(media_col).to_pylist()]
                columns = [part.column(n) for n in names]
                for field in fields[:-1]:
                    name, kind = field.split(" ")
                    columns.append(pa.array([f[name] for f in found], {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}[kind]))
                seek = [f["seek_offsets"] for f in found]
                columns.append(lists(np.array([x for s in seek for x in s], np.int64), np.array([len(s) for s in seek])))
                yield pa.RecordBatch.from_arrays(columns, [*names, *(f.split(" ")[0] for f in fields)])

    picked = df.select(*names)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    return picked.mapInArrow(tidy(run), f"{own}, {SCHEMA}")
