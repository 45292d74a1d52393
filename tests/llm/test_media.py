"""MPEG audio: digests of the query by hand, tags, seek tables, checksums, damaged and padded streams, odd rows."""
import hashlib
import struct
import time
import zlib

import numpy as np

from lectern.llm import mpeg


def test_digests_by_hand(spark):
    texts = [None, "", "abc", "abc", "é" * 500, "x" * 192, "y" * 193, "long " * 60_000]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media_bytes int")
    got = {r["doc_id"]: r for r in mpeg.audio_columns(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        media = mpeg.write_stream(payload)
        r = got[i if i != 3 else None]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        n = len(payload) // 192
        assert f"frames={n};samples={n * 1152};rate=48000;duration_us={n * 24000};crc={n + 1}/{n + 1};skipped=0;table=Info:{n}:" in r["feature"] and len(r["frame_offsets"]) == n
    assert got[2]["feature"] == got[None]["feature"]
    assert mpeg.audio_columns(df.limit(0)).count() == 0


def test_seek_table_of_own_streams():
    s = mpeg.read_stream(mpeg.write_stream(b"z" * 192 * 1000))
    assert s.table_bytes == 1001 * mpeg.FRAME and len(s.table_seek) == 100 and s.texts == {"TSSE": "lectern"}
    for i in range(100):  # the table is exact to 1/256 of the stream
        assert abs(int(s.table_seek[i]) - (mpeg.FRAME + i * 10 * mpeg.FRAME)) <= s.table_bytes // 256 + 1


def frame(header: bytes, body: bytes = b"") -> bytes:
    return (header + body).ljust(mpeg.parse_header(header)[0], b"\0")


PLAIN = bytes((0xFF, 0xFB, 0x94, 0x00))  # layer III, not protected, 128 kbit/s, 48 kHz, stereo: 384 bytes


def test_vbri_and_tags():
    vbri = b"\0" * 32 + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 5000, 12, 3, 2, 2, 4) + struct.pack(">HHH", 768, 768, 768)
    title = b"TIT2" + struct.pack(">IH", 6, 0) + b"\x03h\xc3\xa9llo"[:6]
    id3 = b"ID3\x03\0\0" + bytes((0, 0, 0, len(title))) + title
    v1 = b"TAG" + b"old".ljust(30, b"\0") + b"artist".ljust(30, b"\0") + b"\0" * 65
    s = mpeg.read_stream(id3 + frame(PLAIN, vbri) + frame(PLAIN) * 12 + v1)
    assert (s.table, s.table_frames, s.table_bytes, s.table_step) == ("VBRI", 12, 5000, 4) and s.table_seek.tolist() == [1536, 3072, 4608]
    assert s.tags == ["ID3v2", "ID3v1"] and s.texts == {"TIT2": "héll", "TPE1": "artist"} and len(s.offsets) == 12 and s.skipped == 0


def test_checksums_of_layers():
    head = bytes((0xFF, 0xFE, 0x54, 0xC0))  # layer I, protected, mono
    body = bytes(range(16))
    good = frame(head, struct.pack(">H", mpeg.crc16(head[2:] + body)) + body)
    bad = frame(head, struct.pack(">H", mpeg.crc16(head[2:] + body) ^ 1) + body)
    s = mpeg.read_stream(good * 3 + bad * 2)
    assert (s.checked, s.failed, len(s.offsets), s.samples) == (5, 2, 5, 5 * 384)


def test_padded_streams_take_linear_time():
    pad = bytes((0xFF, 0xFB, 0x92, 0x00))
    one, two = frame(PLAIN), frame(pad)
    took = []
    for n in (4000, 16000):
        data = (one + two) * n
        began = time.perf_counter()
        s = mpeg.read_stream(data)
        took.append(time.perf_counter() - began)
        assert len(s.offsets) == 2 * n and (np.diff(s.offsets) > 0).all()
    assert took[1] < 12 * took[0]


def test_resynchronisation():
    media = mpeg.write_stream(b"q" * 192 * 20)
    at = int(mpeg.read_stream(media).offsets[5])
    for damage in (b"", b"\xff\xfb", b"noise" * 40):
        s = mpeg.read_stream(media[:at] + damage + media[at + 100 :])
        assert 17 <= len(s.offsets) <= 20 and s.skipped > 0
