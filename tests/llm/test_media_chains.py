"""Chains of valid pieces: linear in time, and the same files as a plain walk from every magic string finds."""

import random
import struct
import time
import zlib

import pytest

from rolewise.llm import media

MB = 1 << 20
FRAME = bytes([0xFF, 0xF8, 0x19, 0x08, 0x00])


def crc8(data):
    r = 0
    for byte in data:
        r ^= byte
        for _ in range(8):
            r = (r << 1 ^ (0x07 if r & 0x80 else 0)) & 0xFF
    return r


def crc16(data):
    r = 0
    for byte in data:
        r ^= byte << 8
        for _ in range(8):
            r = (r << 1 ^ (0x8005 if r & 0x8000 else 0)) & 0xFFFF
    return r


def frame(body):
    whole = FRAME + bytes([crc8(FRAME)]) + body
    return whole + crc16(whole).to_bytes(2, "big")


def info(samples):
    return b"\0\0\0\x22" + bytes(13) + samples.to_bytes(5, "big") + bytes(16)


CHAINS = {
    "boxes": b"\0\0\0\x08ftyp",
    "boxes of others": b"\0\0\0\x08ftyp\0\0\0\x08free",
    "pages": b"OggS\0\0" + bytes(20) + b"\x01\x05hello",
    "chunks": b"RIFF\0\0\x08\0WAVEnote\x04\0\0\0abcd",
    "riff in riff": b"RIFF\x04\0\x08\0WAVE",
    "gif blocks": b"GIF89a" + b"\x21\x01\x01\x01" * 2 + b"\0!\x05\x04abcd",
    "png chunks": b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s13sI", 13, b"IHDR", bytes(13), zlib.crc32(b"IHDR" + bytes(13))) + struct.pack(">I4s", MB // 2, b"tEXt"),
    "jpeg segments": b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1\0\x02",
    "zip ends": b"PK\x01\x02" + bytes(42) + b"PK\x05\x06" + bytes(4) + b"\x01\0\x01\0\x2e\0\0\0\0\0\0\0\0\0",
    "flac heads": b"fLaC" + b"\0" + info(0)[1:] + b"\x01\0\0\x10" + bytes(16),
    "frames": b"fLaC" + b"\x80" + info(0)[1:] + frame(b"sound"),
    "frame headers": b"fLaC" + b"\x80" + info(0)[1:] + FRAME + bytes([crc8(FRAME)]) + b"no checksum",
}


@pytest.mark.parametrize("name", CHAINS)
def test_a_megabyte_of_chained_pieces(name):
    piece = CHAINS[name]
    value = piece * (MB // len(piece))
    spent = []
    for part in (value[: len(value) // 4], value):
        start = time.process_time()
        media.files_in(part)
        spent.append(time.process_time() - start)
    assert spent[1] < 12 and spent[1] < 9 * spent[0] + 1, spent


def plain_riff(b, at, form, needed):
    if b[at + 8 : at + 12] != form:
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    p, found = at + 12, set()
    while end <= len(b) and p + 8 <= end:
        found.add(b[p : p + 4])
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        p += 8 + n + (n & 1)
    return end if end <= len(b) and p == end and found & needed else None


def plain_mp4(b, at):
    p = start = at - 4
    kinds = set()
    while start >= 0 and p + 8 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if n < 8 or p + n > len(b) or not kind.isalnum():
            break
        kinds.add(kind)
        p += n
    return p if b"ftyp" in kinds and kinds & {b"moov", b"mdat", b"meta"} else None


def plain_zip(b):
    out = {}
    for end in range(len(b) - 21):
        if b[end : end + 4] == b"PK\x05\x06":
            entries, size, start, note = struct.unpack("<HIIH", b[end + 10 : end + 22])
            p = end - size
            for _ in range(entries):
                if p < 0 or p + 46 > end or b[p : p + 4] != b"PK\x01\x02":
                    break
                p += 46 + sum(struct.unpack("<HHH", b[p + 28 : p + 34]))
            else:
                if p == end and p >= 0 and end + 22 + note <= len(b):
                    out[end - size - start] = end + 22 + note
    return out


def test_walks_are_those_of_plain_versions():
    rng = random.Random(11)
    box = lambda kind, n: struct.pack(">I", 8 + n) + kind + rng.randbytes(n)
    chunk = lambda kind, n: kind + struct.pack("<I", n) + bytes(n + (n & 1))
    entry = lambda: b"PK\x01\x02" + bytes(24) + struct.pack("<HHH", rng.randrange(4), 0, rng.randrange(3)) + bytes(12 + 3)
    found = 0
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 14)):
            kind = rng.randrange(4)
            if kind == 0:
                parts.append(box(rng.choice([b"ftyp", b"mdat", b"free", b"moov", b"a b!"]), rng.randrange(5)))
            elif kind == 1:
                inner = b"".join(chunk(rng.choice([b"data", b"fmt ", b"VP8 ", b"RIFF"]), rng.randrange(6)) for _ in range(rng.randrange(4)))
                parts.append(b"RIFF" + struct.pack("<I", 4 + len(inner) + rng.choice([0, 0, 0, 8, 1])) + rng.choice([b"WAVE", b"WEBP"]) + inner)
            elif kind == 2:
                entries = [entry() for _ in range(rng.randrange(3))]
                size = sum(map(len, entries)) + rng.choice([0, 0, 0, 3])
                parts.append(b"".join(entries) + b"PK\x05\x06" + bytes(6) + struct.pack("<HIIH", len(entries) + rng.choice([0, 0, 1]), size, rng.randrange(3), rng.choice([0, 0, 2])))
            else:
                parts.append(rng.randbytes(rng.randrange(6)))
        b = b"".join(parts)
        v = media.Value(b)
        for at in range(len(b) - 11):
            if b[at : at + 4] == b"RIFF":
                for check, form, needed in ((media._wav, b"WAVE", {b"data"}), (media._webp, b"WEBP", {b"VP8 ", b"VP8L", b"VP8X"})):
                    assert check(v, at) == plain_riff(b, at, form, needed)
                    found += check(v, at) is not None
            if b[at : at + 4] == b"ftyp":
                assert media._mp4(v, at) == plain_mp4(b, at)
                found += media._mp4(v, at) is not None
        assert {k: e for k, e in v.zip_ends.items() if k >= 0} == {k: e for k, e in plain_zip(b).items() if k >= 0}
        found += len(v.zip_ends)
    assert found > 200


def test_checksums_of_parts(monkeypatch):
    monkeypatch.setattr(media, "STEP", 16)
    rng = random.Random(3)
    data = rng.randbytes(1000)
    v = media.Value(data)
    for _ in range(300):
        p = rng.randrange(1000)
        q = rng.randrange(p, 1001)
        assert v.crc(p, q) == zlib.crc32(data[p:q])
    sums = media.Value(data[:300]).frames[0]
    for _ in range(300):
        p = rng.randrange(300)
        q = rng.randrange(p, 301)
        assert (sums[p] == sums[q]) == (crc16(data[p:q]) == 0)
    body = data[:40]
    whole = frame(body)
    assert media.Value(whole).frames[0][0] == media.Value(whole).frames[0][len(whole)]


def test_frames_end_where_their_checksum_is_right():
    rng = random.Random(5)
    for wanted in (0, 192, 192 * 3, 192 * 9):
        frames = [frame(rng.randbytes(rng.randrange(8, 60))) for _ in range(3)]
        song = b"fLaC\x80" + info(wanted)[1:] + b"".join(frames)
        end = len(song) - (len(frames[1]) + len(frames[2]) if wanted == 192 else 0)
        kinds = media.files_in(song + b" and more")
        assert kinds[0][:2] == ("audio/flac", 0) and kinds[0][2] <= len(song)
        if wanted != 192:
            assert media.files_in(song)[0] == ("audio/flac", 0, len(song))
        else:
            assert media.files_in(song[:end])[0] == ("audio/flac", 0, end)
