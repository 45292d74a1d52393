"""Texts as MPEG audio: a lossless store of bytes in the frames' ancillary data, and a reader of such streams.

The writer makes MPEG-1 layer III frames (mono, 48 kHz, 80 kbit/s: 240 bytes) that decode to silence: their side
information claims no main data, so the rest of each frame is ancillary data, of which 192 bytes are payload. Before
them stand an ID3v2 tag and an Info frame with the frame count, the byte count and a seek table.

The reader is general: it reads the text fields of ID3v2 and ID3v1 tags, resynchronises on frame headers after garbage,
reads the counts and seek tables of Xing, Info and VBRI frames, verifies the CRC-16 of protected frames (layers I and III;
it has not the tables that layer II needs), and reports exact durations (samples over the sampling rate) and the byte offset
of every frame. Streams of free format are passed over as garbage.

Defined results: a null or empty text becomes one unit of spaces; texts of any length are stored whole, frame by frame
in numpy; equal texts give equal bytes; other columns stay; an empty table gives an empty table.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Payload bytes of a frame.
UNIT = 192
#: Bit rates in kbit/s by (version 1?, layer) and sampling rates in Hz by version (fixed values of the standard).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: The writer's frame: header (layer III, protected, 80 kbit/s, 48 kHz, mono), CRC, 17 bytes of side information.
HEADER = bytes((0xFF, 0xFA, 0x64, 0xC0))
SIDE = 17
FRAME = 240
BODY = 4 + 2 + SIDE


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio frames (polynomial 0x8005, start 0xFFFF)."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


#: All data frames share header and side information, and so the checksum.
_START = HEADER + struct.pack(">H", crc16(HEADER[2:] + bytes(SIDE))) + bytes(SIDE)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text, and those bytes filled with spaces up to a positive multiple of the unit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def write_stream(payload: bytes) -> bytes:
    """An MPEG audio stream that holds the payload, whose length is a multiple of the unit."""
    n = len(payload) // UNIT
    tag = b"TSSE" + struct.pack(">IH", 9, 0) + b"\x03lectern\x00"
    size = len(tag)
    id3 = b"ID3\x04\x00\x00" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + tag
    total = (n + 1) * FRAME
    toc = bytes(min(255, 256 * (FRAME + (i * n // 100) * FRAME) // total) for i in range(100))
    info = _START + b"Info" + struct.pack(">III", 7, n, total) + toc
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, :BODY] = np.frombuffer(_START, np.uint8)
    frames[:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return id3 + info.ljust(FRAME, b"\x00") + frames.tobytes()


@dataclass
class Stream:
    """What a stream holds. `offsets` has the audio frames, without the table frame."""

    offsets: np.ndarray
    rate: int = 0
    samples: int = 0
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    table: str = ""
    table_frames: int = 0
    table_bytes: int = 0
    #: Byte positions that the table gives, from the stream's first frame: at each hundredth (Xing, Info), or after each
    #: `table_step` frames (VBRI).
    table_seek: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    table_step: int = 0
    tags: list[str] = field(default_factory=list)
    #: Text fields of the tags by name; the first of a name counts.
    texts: dict[str, str] = field(default_factory=dict)

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def parse_header(b: bytes) -> tuple[int, int, int, int, int, bool] | None:
    """(frame bytes, samples, rate, side information bytes, layer, protected) of four header bytes, or None."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, bits, rate = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    first, hz, pad = version == 3, RATES[version][rate], b[2] >> 1 & 1
    kbit = BITRATES[first, layer][bits]
    mono = b[3] >> 6 == 3
    if layer == 1:
        return (12000 * kbit // hz + pad) * 4, 384, hz, 0, 1, not b[1] & 1
    samples = 1152 if first or layer == 2 else 576
    side = 0 if layer == 2 else (17 if mono else 32) if first else (9 if mono else 17)
    return samples // 8 * 1000 * kbit // hz + pad, samples, hz, side, layer, not b[1] & 1


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(body: bytes, version: int, texts: dict[str, str]) -> None:
    """Text frames of an ID3v2 tag (versions 3 and 4); others are passed over, a broken rest is left."""
    at = 0
    while at + 10 <= len(body) and body[at : at + 4].strip(b"\0").isalnum():
        name = body[at : at + 4].decode("latin-1")
        size = _synchsafe(body[at + 4 : at + 8]) if version == 4 else struct.unpack(">I", body[at + 4 : at + 8])[0]
        value = body[at + 10 : at + 10 + size]
        if name[0] == "T" and value and value[0] < 4 and name != "TXXX":
            form = ("latin-1", "utf-16", "utf-16-be", "utf-8")[value[0]]
            texts.setdefault(name, value[1:].decode(form, "replace").rstrip("\0"))
        at += 10 + size


#: Fields of an ID3v1 tag: frame name of the same meaning, first and last byte.
ID3V1 = (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97))


def _table(frame: bytes, begin: int, out: Stream) -> bool:
    """Whether a first frame is a table frame; what it says goes into the stream."""
    kind = frame[begin : begin + 4]
    if kind in (b"Xing", b"Info"):
        flags = struct.unpack(">I", frame[begin + 4 : begin + 8])[0]
        at = begin + 8
        out.table = kind.decode()
        if flags & 1:
            out.table_frames, at = struct.unpack(">I", frame[at : at + 4])[0], at + 4
        if flags & 2:
            out.table_bytes, at = struct.unpack(">I", frame[at : at + 4])[0], at + 4
        if flags & 4 and len(frame) >= at + 100:
            out.table_seek = np.frombuffer(frame, np.uint8, 100, at).astype(np.int64) * out.table_bytes // 256
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table = "VBRI"
        out.table_bytes, out.table_frames = struct.unpack(">II", frame[46:54])
        entries, scale, width, out.table_step = struct.unpack(">HHHH", frame[54:62])
        raw = np.frombuffer(frame[62 : 62 + entries * width], np.uint8)
        if 1 <= width <= 4 and len(raw) == entries * width:
            sizes = (raw.reshape(entries, width).astype(np.int64) << (8 * np.arange(width)[::-1])).sum(axis=1) * scale
            out.table_seek = np.cumsum(sizes)
        return True
    return False


def _same_headers(whole: np.ndarray, at: int, size: int, most: int) -> int:
    """How many frames of one size in a row have the first one's header; looked at in growing blocks, so that the work
    follows the run."""
    n, block, head = 1, 16, whole[at : at + 4]
    while n < most:
        k = min(block, most - n)
        same = (whole[at + n * size : at + (n + k) * size].reshape(k, size)[:, :4] == head).all(axis=1)
        if not same.all():
            return n + int(np.argmin(same))
        n, block = n + k, 2 * block
    return n


def _covered(header: bytes, layer: int, side: int) -> int:
    """Bytes after the checksum that it covers; -1 in layer II, whose tables of bits this reader does not have."""
    if layer == 3:
        return side
    if layer == 2:
        return -1
    mode, bound = header[3] >> 6, 4 * (header[3] >> 4 & 3) + 4
    return 16 if mode == 3 else 32 if mode != 1 else (bound * 2 + 32 - bound) // 2


def read_stream(data: bytes) -> Stream:
    """Parses a whole stream. A header counts if the stream ends after its frame or another header follows there."""
    at, end, out = 0, len(data), Stream(np.zeros(0, np.int64))
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = _synchsafe(data[at + 6 : at + 10])
        _id3v2(data[at + 10 : at + 10 + size], data[at + 3], out.texts)
        at += 10 + size + (10 if data[at + 5] & 16 else 0)
        out.tags.append("ID3v2")
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags.append("ID3v1")
        for name, a, z in ID3V1:
            value = data[end + a : end + z].split(b"\0")[0].decode("latin-1").strip()
            if value:
                out.texts.setdefault(name, value)
    whole = np.frombuffer(data, np.uint8)
    parts: list[np.ndarray] = []
    first = True
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        if h is None or at + h[0] > end or (at + h[0] + 4 <= end and parse_header(data[at + h[0] : at + h[0] + 4]) is None):
            nxt = data.find(b"\xff", at + 1, end)
            out.skipped += (nxt if nxt >= 0 else end) - at
            at = nxt if nxt >= 0 else end
            continue
        size, samples, hz, side, layer, protected = h
        table = first and layer == 3 and _table(data[at : at + size], 4 + 2 * protected + side, out)
        n = 1 if table else _same_headers(whole, at, size, (end - at) // size)
        rows = whole[at : at + n * size].reshape(n, size)
        if not table:
            parts.append(at + np.arange(n, dtype=np.int64) * size)
            out.samples += n * samples
        covered = _covered(data[at : at + 4], layer, side) if protected else -1
        if covered >= 0 and size >= 6 + covered:
            block = rows[:, : 6 + covered]
            kinds, count = (block[:1], np.array([n])) if (block == block[0]).all() else np.unique(block, axis=0, return_counts=True)
            good = np.array([crc16(k[2:4].tobytes() + k[6:].tobytes()) == int(k[4]) << 8 | int(k[5]) for k in kinds])
            out.checked += n
            out.failed += int(count[~good].sum())
        out.rate, first = hz, False
        at += n * size
    out.skipped += max(0, end - at)
    out.offsets = np.concatenate(parts) if parts else out.offsets
    return out


def payload_from(data: bytes, stream: Stream) -> bytes:
    """The payload of a stream that write_stream made."""
    whole = np.frombuffer(data, np.uint8)
    first, n = int(stream.offsets[0]), len(stream.offsets)
    if (np.diff(stream.offsets) == FRAME).all():
        return whole[first : first + n * FRAME].reshape(n, FRAME)[:, BODY : BODY + UNIT].tobytes()
    return b"".join(data[o + BODY : o + BODY + UNIT] for o in stream.offsets.tolist())


def _row(text: str | None) -> tuple:
    n_bytes, payload = payload_of(text)
    media = write_stream(payload)
    s = read_stream(media)
    back = payload_from(media, s)
    seek = hashlib.sha256(s.offsets.astype("<i8").tobytes()).hexdigest()[:16]
    feature = f"frames={len(s.offsets)};samples={s.samples};rate={s.rate};duration_us={s.duration_us};crc={s.checked - s.failed}/{s.checked};skipped={s.skipped};table={s.table}:{s.table_frames}:{s.table_bytes}:{len(s.table_seek)};by={s.texts.get('TSSE', '')};first={int(s.offsets[0])};seek={seek}"
    return n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.offsets


def store_as_audio(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (without the text) with the stored form `media` (binary)."""
    kept = [c for c in docs.columns if c not in (text, "media")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i : i + 64]
                yield part[kept].assign(media=[write_stream(payload_of(t if isinstance(t, str) else None)[1]) for t in part[text]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema.fields)
    return docs.select(*[f"`{c}`" for c in [*kept, text]]).mapInPandas(run, f"{schema}, media binary")


def audio_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: digests of the payload that was read back and of the stored form, the features, every frame's offset."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frame_offsets"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                rows = [_row(t if isinstance(t, str) else None) for t in part[text]]
                yield pd.DataFrame(rows, columns=names).assign(**{key: part[key].to_numpy()})[[key, *names]]

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frame_offsets array<bigint>"
    return docs.select(key, text).mapInPandas(run, schema)
