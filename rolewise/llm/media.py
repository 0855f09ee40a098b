"""Media columns: signature sniffing.

An Aho-Corasick automaton finds every magic string in a binary value in one pass.  A validator for each format then
follows the structure from there (chunk lengths, checksums, end markers) and gives the length of the file, or nothing if
the place is no such file.  A valid file at the start corrects the declared type; valid files further in are carved out as
embedded media.

A value takes time in proportion to its length, also if valid pieces follow each other without an end.  What a format only tells at its end (ZIP, PDF) is found once for a value.  Where a format is a chain of pieces
(pages, boxes, chunks, segments, blocks), where the chain from a place ends is remembered for every place that it went through, so no piece is walked twice.  RIFF chunks, whose chain
must meet an end that the header gives, are a forest whose intervals tell that.  Checksums of parts come from those of the value's beginnings.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolewise.llm.common import in_batches

#: Payloads are padded with spaces to a multiple of this many bytes, at least one.
PAD, RATE = 192, 8000
#: The type that stored texts are declared as.
DECLARED = "text/plain"


class Value:
    """A binary value and what validators look up in it, found when it is first asked for."""

    def __init__(self, data: bytes):
        self.data, self.b = data, memoryview(data)
        self.ends: dict[tuple[str, int], object] = {}

    def chain(self, kind: str, at: int, step: Callable[[int], tuple[int | None, object]]) -> object:
        """What the chain of pieces from ``at`` comes to.  ``step`` gives the place after a piece, or none and the outcome; every place that was passed has the same one."""
        passed: list[int] = []
        p: int | None = at
        while p is not None:
            if (kind, p) in self.ends:
                out = self.ends[kind, p]
                break
            passed.append(p)
            p, out = step(p)
        for q in passed:
            self.ends[kind, q] = out
        return out

    @cached_property
    def _sums(self) -> list[int]:
        """CRC-32 of the value up to each multiple of ``STEP``."""
        out = [0]
        for p in range(0, len(self.data) - STEP + 1, STEP):
            out.append(zlib.crc32(self.b[p : p + STEP], out[-1]))
        return out

    def crc(self, p: int, q: int) -> int:
        """CRC-32 of the bytes from ``p`` to ``q``: that of all before ``q``, less that of all before ``p`` moved on by as many bytes."""
        if q - p <= 2 * STEP:
            return zlib.crc32(self.b[p:q])
        until = lambda x: zlib.crc32(self.b[x // STEP * STEP : x], self._sums[x // STEP])
        return until(q) ^ _moved(until(p), q - p)

    @cached_property
    def chunks(self) -> dict[int, tuple[int, ...]]:
        """The :func:`forest` of RIFF chunks, with how many of sound and of pictures lead from a place to its root."""
        starts = (m.start() + 12 for m in re.finditer(b"RIFF", self.data))

        def after(p: int) -> int | None:
            n = int.from_bytes(self.b[p + 4 : p + 8], "little")
            return p + 8 + n + (n & 1) if p + 8 <= len(self.data) else None

        return forest(starts, after, lambda p: ((name := self.data[p : p + 4]) == b"data", name in (b"VP8 ", b"VP8L", b"VP8X")))

    @cached_property
    def frames(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[int]]]:
        """For FLAC: a sum up to each byte, such that a part's CRC-16 is zero if those before and at its end are alike; places by sum; and those before a frame's header."""
        x = np.frombuffer(self.data, dtype=np.uint8).astype(np.uint32)
        powers = _inverse_powers(len(x))
        sums = np.concatenate((np.zeros(1, dtype=np.uint32), np.bitwise_xor.accumulate(_times(powers, x, 8)) if len(x) else np.zeros(0, dtype=np.uint32)))
        order = np.argsort(sums, kind="stable")
        heads: dict[int, list[int]] = {}
        for h in np.flatnonzero((x[:-1] == 0xFF) & (x[1:] & 0xFE == 0xF8)).tolist() if len(x) > 1 else []:
            if _flac_header(self.b, h):
                heads.setdefault(int(sums[h]), []).append(h)
        return sums, order, sums[order], heads

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """Start to end of the archives whose directory is where their end record says."""
        told = []
        for m in re.finditer(b"PK\x05\x06", self.data):
            end = m.start()
            if end + 22 <= len(self.data):
                entries, size, start, note = struct.unpack("<HIIH", self.data[end + 10 : end + 22])
                if end - size >= 0 and end + 22 + note <= len(self.data):
                    told.append((end, entries, size, start, note))

        def after(p: int) -> int | None:
            if self.data[p : p + 4] != b"PK\x01\x02" or p + 46 > len(self.data):
                return None
            return p + 46 + sum(struct.unpack("<HHH", self.data[p + 28 : p + 34]))

        places = forest((end - size for end, _, size, _, _ in told), after, lambda p: (1,))
        out = {}
        for end, entries, size, start, note in told:
            if entries == 0:
                whole = size == 0
            else:
                first, last = places.get(end - size), places.get(end)
                whole = first is not None and last is not None and leads(first, last) and first[2] - last[2] == entries
            if whole:
                out[end - size - start] = end + 22 + note
        return out

    @cached_property
    def pdf_ends(self) -> dict[int, int]:
        """Start to end of the documents whose last reference table is where they say, later updates included."""
        tables = [m.start() for m in re.finditer(rb"(?<!start)xref", self.data)]
        objects = [m.start() for m in re.finditer(rb"(?<!\d)\d{1,10} \d{1,5} obj", self.data)]
        out = {}
        for m in re.finditer(rb"startxref\s{1,4}(\d{1,12})\s{1,4}%%EOF", self.data):
            for places in (objects, tables):
                if k := bisect_right(places, m.start()):
                    out[places[k - 1] - int(m[1])] = m.end()
        return out

    @cached_property
    def jpeg_marks(self) -> np.ndarray:
        """Places of markers within entropy-coded data: FF and neither 00 nor a restart."""
        x = np.frombuffer(self.data, dtype=np.uint8)
        return np.flatnonzero((x[:-1] == 0xFF) & (x[1:] != 0) & ((x[1:] < 0xD0) | (x[1:] > 0xD7)))


#: Bytes between the sums that are kept.
STEP = 4096


def forest(starts: Iterable[int], after: Callable[[int], int | None], marks: Callable[[int], tuple[int, ...]]) -> dict[int, tuple[int, ...]]:
    """All places on the chains from ``starts``, each with (entered, left) of a walk over the trees that the chains join to, and the sums of ``marks`` from it to its root.

    ``after`` gives the place after a piece, further on, or none.  Every piece is looked at once.  A place without one before or after it isn't told.
    """
    next_: dict[int, int] = {}
    for p in starts:
        while p not in next_ and (q := after(p)) is not None:
            next_[p] = p = q
    before: dict[int, list[int]] = {}
    for p, q in next_.items():
        before.setdefault(q, []).append(p)
    entered: dict[int, tuple[int, ...]] = {}
    out: dict[int, tuple[int, ...]] = {}
    for root in set(before) - set(next_):
        open_: list[tuple[int, tuple[int, ...] | None]] = [(root, tuple(0 for _ in marks(root)))]
        while open_:
            p, sums = open_.pop()
            if sums is None:
                out[p] = (entered[p][0], len(entered), *entered[p][1:])
                continue
            entered[p] = (len(entered), *sums)
            open_.append((p, None))
            open_ += [(q, tuple(a + int(b) for a, b in zip(sums, marks(q), strict=True))) for q in before.get(p, ())]
    return out


def leads(first: tuple[int, ...], last: tuple[int, ...]) -> bool:
    """Whether the chain from one place of a :func:`forest` goes through another."""
    return last[0] <= first[0] and first[1] <= last[1]


@lru_cache(maxsize=1)
def _shifts() -> list[list[int]]:
    """What 1, 2, 4 … zero bytes make of each bit of a CRC-32."""
    one = [0xEDB88320, *[1 << k for k in range(31)]]  # one zero bit
    for _ in range(3):
        one = [_applied(one, v) for v in one]
    each = [one]
    for _ in range(40):
        each.append([_applied(each[-1], v) for v in each[-1]])
    return each


def _applied(matrix: list[int], value: int) -> int:
    out, k = 0, 0
    while value:
        if value & 1:
            out ^= matrix[k]
        value >>= 1
        k += 1
    return out


def _moved(crc: int, n: int) -> int:
    """A CRC-32 after ``n`` more zero bytes."""
    for k, matrix in enumerate(_shifts()):
        if n >> k & 1:
            crc = _applied(matrix, crc)
    return crc


def _times(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Products of remainders modulo the polynomial of FLAC's CRC-16, ``b`` of so many bits."""
    out = np.zeros_like(a)
    for k in range(bits - 1, -1, -1):
        out = ((out << 1) ^ np.where(out & 0x8000, np.uint32(0x18005), np.uint32(0))) & np.uint32(0xFFFF)
        out ^= np.where(b >> np.uint32(k) & np.uint32(1), a, np.uint32(0))
    return out


def _inverse_powers(n: int) -> np.ndarray:
    """Remainders of x to the power of -8k for k from 0 to ``n`` - 1."""
    one = 1
    for _ in range(8):  # divided by x: the polynomial has a last 1
        one = (one ^ 0x18005 if one & 1 else one) >> 1
    out, step = np.ones(1, dtype=np.uint32), np.full(1, one, dtype=np.uint32)
    while len(out) < n:
        out = np.concatenate((out, _times(out, np.broadcast_to(step, out.shape), 16)))
        step = _times(step, step, 16)
    return out[:n]


# -- validators: (value, place of the magic string) -> end of the file, or None ------------------------------------


def _riff(v: Value, at: int, form: bytes, kind: int) -> int | None:
    b = v.b
    if at + 12 > len(b) or bytes(b[at + 8 : at + 12]) != form:
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b) or at + 12 not in v.chunks or end not in v.chunks:
        return None
    first, last = v.chunks[at + 12], v.chunks[end]
    return end if leads(first, last) and first[2 + kind] > last[2 + kind] else None


def _wav(v: Value, at: int) -> int | None:
    return _riff(v, at, b"WAVE", 0)


def _webp(v: Value, at: int) -> int | None:
    return _riff(v, at, b"WEBP", 1)


def _png(v: Value, at: int) -> int | None:
    b = v.b

    def chunk(p: int) -> tuple[int | None, object]:
        n = int.from_bytes(b[p : p + 4], "big")
        if p + 12 + n > len(b) or (kind := bytes(b[p + 4 : p + 8])) == b"IHDR" or not whole(p, n):
            return None, None
        return (None, p + 12 + n) if kind == b"IEND" else (p + 12 + n, None)

    def whole(p: int, n: int) -> bool:
        return v.crc(p + 4, p + 8 + n) == int.from_bytes(b[p + 8 + n : p + 12 + n], "big")

    p = at + 8
    n = int.from_bytes(b[p : p + 4], "big")
    if p + 12 + n > len(b) or bytes(b[p + 4 : p + 8]) != b"IHDR" or not whole(p, n):
        return None
    return v.chain("png", p + 12 + n, lambda p: chunk(p) if p + 12 <= len(b) else (None, None))


def _gif(v: Value, at: int) -> int | None:
    b = v.b

    def data(p: int) -> tuple[int | None, object]:
        return (None, None) if p >= len(b) else (p + b[p] + 1, None) if b[p] else (None, p + 1)

    def block(p: int) -> tuple[int | None, object]:
        if p >= len(b):
            return None, None
        if b[p] == 0x3B:
            return None, p + 1
        if b[p] == 0x21:
            return v.chain("gif data", p + 2, data), None
        if b[p] == 0x2C and p + 10 <= len(b):
            flags = b[p + 9]
            return v.chain("gif data", p + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), data), None
        return None, None

    if at + 13 > len(b):
        return None
    return v.chain("gif", at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0), block)


def _jpeg(v: Value, at: int) -> int | None:
    b = v.b

    def segment(p: int) -> tuple[int | None, object]:
        if p + 4 > len(b) or b[p] != 0xFF:
            return None, None
        mark, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2 or p + 2 + n > len(b):
            return None, None
        p += 2 + n
        if mark == 0xDA:  # entropy-coded data follows, up to a marker
            k = int(np.searchsorted(v.jpeg_marks, p))
            if k == len(v.jpeg_marks):
                return None, None
            p = int(v.jpeg_marks[k])
            if b[p + 1] == 0xD9:
                return None, p + 2
        return p, None

    return v.chain("jpeg", at + 2, segment)


def _bmp(v: Value, at: int) -> int | None:
    b = v.b
    if at + 54 > len(b):
        return None
    size, _, start, header, width, height, planes, bits = struct.unpack("<IIIIiiHH", b[at + 2 : at + 30])
    row = (abs(width) * bits + 31) // 32 * 4
    plain = header >= 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= start <= size
    return at + size if plain and size == start + row * abs(height) and at + size <= len(b) else None


def _gzip(v: Value, at: int) -> int | None:
    b = v.b
    whole = zlib.decompressobj(wbits=31)
    try:
        p = at
        while p < len(b) and not whole.eof:  # in pieces, so that what it unpacks to is never held
            whole.decompress(whole.unconsumed_tail or b[p : p + 65536], 1 << 20)
            p += 0 if whole.unconsumed_tail else 65536
    except zlib.error:
        return None
    return min(p, len(b)) - len(whole.unused_data) if whole.eof else None


def _zip(v: Value, at: int) -> int | None:
    return v.zip_ends.get(at)


def _pdf(v: Value, at: int) -> int | None:
    return v.pdf_ends.get(at)


@lru_cache(maxsize=2)
def _crc_table(bits: int, polynomial: int) -> list[int]:
    """Remainders of all bytes, highest bit first."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for byte in range(256):
        r = byte << (bits - 8)
        for _ in range(8):
            r = ((r << 1) ^ (polynomial if r & top else 0)) & mask
        table.append(r)
    return table


def _flac_header(b: memoryview, p: int) -> tuple[int, int] | None:
    """The length of the frame header at ``p`` and the samples of its block, if its checksum is right."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 3] & 1:
        return None
    code, rate, lead = b[p + 2] >> 4, b[p + 2] & 15, b[p + 4]
    more = 0 if lead < 0x80 else next((k for k in range(1, 7) if not lead >> (6 - k) & 1), 0)  # a number like those of UTF-8
    q = p + 5 + more
    extra = {6: 1, 7: 2}.get(code, 0)
    size = q + extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if code == 0 or rate == 15 or size >= len(b):
        return None
    samples = int.from_bytes(b[q : q + extra], "big") + 1 if extra else 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    crc, table = 0, _crc_table(8, 0x07)
    for byte in b[p:size]:
        crc = table[crc ^ byte]
    return (size + 1 - p, samples) if crc == b[size] else None


def _flac(v: Value, at: int) -> int | None:
    """Metadata blocks, then frames up to the number of samples that the first block gives (or while frames follow, if it gives none).

    A frame ends where its checksum is right and the next header is; the last one at the value's end or, if it is not right there, where it
    first is.
    """
    b = v.b

    def block(p: int) -> tuple[int | None, object]:
        if p + 4 > len(b) or p + 4 + (n := int.from_bytes(b[p + 1 : p + 4], "big")) > len(b):
            return None, None
        return (None, p + 4 + n) if b[p] >> 7 else (p + 4 + n, None)

    p = at + 4
    if p + 4 > len(b) or (b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")) != (0, 34) or p + 38 > len(b):
        return None
    wanted = int.from_bytes(b[p + 17 : p + 22], "big") & ((1 << 36) - 1)
    if (p := v.chain("flac", p, block)) is None or not _flac_header(b, p):
        return None
    sums, order, ordered, heads = v.frames

    def frame(p: int) -> tuple[int | None, object]:
        """The next frame, or none and the end of this one, if it is the last."""
        least = p + _flac_header(b, p)[0] + 3
        same = heads.get(int(sums[p]), [])
        k = bisect_left(same, least)
        return (same[k], None) if k < len(same) else (None, last(p, least))

    def last(p: int, least: int) -> int | None:
        if least <= len(b) and sums[len(b)] == sums[p]:
            return len(b)
        k = int(np.searchsorted(ordered, sums[p]))
        k += int(np.searchsorted(order[k : int(np.searchsorted(ordered, sums[p], side="right"))], least))
        return int(order[k]) if k < len(order) and ordered[k] == sums[p] and order[k] >= least else None

    if not wanted:
        return v.chain("flac frames", p, frame)
    seen = 0
    while True:
        size, samples = _flac_header(b, p)
        seen += samples
        if seen >= wanted:
            return last(p, p + size + 3)
        following, end = frame(p)
        if following is None:
            return end
        p = following


def _ogg(v: Value, at: int) -> int | None:
    b = v.b

    def page(p: int) -> tuple[int | None, object]:
        if p + 27 > len(b) or bytes(b[p : p + 5]) != b"OggS\0" or p + 27 + b[p + 26] > len(b):
            return None, None
        after = p + 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
        return (None, None) if after > len(b) else (None, after) if b[p + 5] & 4 else (after, None)

    return v.chain("ogg", at, page)


def _mp4(v: Value, at: int) -> int | None:
    """The boxes from one that names the type on, and what comes after the last; there must be one with content."""
    b = v.b

    def box(p: int, kinds: tuple[bytes, ...]) -> tuple[int | None, object]:
        n, kind = int.from_bytes(b[p : p + 4], "big"), bytes(b[p + 4 : p + 8])
        if p + 8 > len(b) or n < 8 or p + n > len(b) or not kind.isalnum():
            return None, p
        return (None, True) if kind in kinds else (p + n, False)

    if at < 4:
        return None
    # where the boxes end, and whether one with content is among them; a place that isn't a box ends both
    end = v.chain("mp4", at - 4, lambda p: box(p, ()))
    content = v.chain("mp4 content", at - 4, lambda p: box(p, (b"moov", b"mdat", b"meta")))
    return end if end > at - 4 and content is True else None


#: The magic strings that the formats' specifications give.
FORMATS: list[tuple[bytes, str, Callable[[Value, int], int | None]]] = [
    (b"RIFF", "audio/wav", _wav),
    (b"RIFF", "image/webp", _webp),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "audio/ogg", _ogg),
    (b"ftyp", "video/mp4", _mp4),
]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    by_magic: dict[str, list[int]] = {}
    for i, (magic, _, _) in enumerate(FORMATS):
        by_magic.setdefault(magic.decode("latin-1"), []).append(i)
    found = ahocorasick.Automaton()
    for magic, which in by_magic.items():
        found.add_word(magic, (len(magic), which))
    found.make_automaton()
    return found


def files_in(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of every valid file that is in no file found before it, by start."""
    value, out, free = Value(data), [], 0
    for last, (n, which) in _automaton().iter(data.decode("latin-1")):
        at = last - n + 1
        for i in which:
            kind, check = FORMATS[i][1:]
            start = at - 4 if check is _mp4 else at
            if start >= free and (end := check(value, at)) is not None:
                out.append((kind, start, end))
                free = end
                break
    return out


# -- the stored form: 8-bit mono PCM in RIFF/WAVE ------------------------------------------------------------------


def store(payload: bytes) -> bytes:
    """``payload`` as the unsigned 8-bit samples of a WAVE file; the length must be even."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(wav: bytes | memoryview) -> bytes:
    """The bytes of a WAVE file's data chunk."""
    p = 12
    while p + 8 <= len(wav):
        n = int.from_bytes(wav[p + 4 : p + 8], "little")
        if bytes(wav[p : p + 4]) == b"data":
            return bytes(wav[p + 8 : p + 8 + n])
        p += 8 + n + (n & 1)
    raise ValueError("the file has no data chunk")


def feature(payload: bytes) -> str:
    """Loudness of the samples, from whole sums so that equal samples give equal strings: mean, spread, and by eighths."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    rise = int((np.diff(x) > 0).sum())
    parts = [int(p.sum()) * 100 // max(len(p), 1) for p in np.array_split(x, 8)]
    mean, square = int(x.sum()) * 100 // len(x), int((x * x).sum()) // len(x)
    return f"audio/wav;samples={len(x)};mean={mean};square={square};rising={rise};eighths={'.'.join(map(str, parts))}"


def _padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % PAD or PAD * (not text))


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_media(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``declared`` and ``media``: each text stored as a WAVE file.

    The text's UTF-8 is padded with spaces to a positive multiple of 192 bytes; a null text is an empty one.  The
    declared type is that of the text, which sniffing has to correct.  Repeated rows stay; extra columns are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_py() or b"" for t in batch.column(1)]
            media = [store(_padded(t)) for t in raw]
            made = [pa.array([len(t) for t in raw], pa.int64()), pa.array([DECLARED] * len(raw), pa.string()), pa.array(media, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_bytes", "declared", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", F.col("text").cast("string").cast("binary")), run, f"doc_id {kind}, n_bytes bigint, declared string, media binary")


def _sniffed(data: bytes, declared: str | None) -> tuple[str | None, bool, bool, list[tuple[str, int, int]]]:
    """The type of ``data``, whether a file starts it, whether that file's type isn't the declared one, and all files in it."""
    found = files_in(data)
    at_start = bool(found) and found[0][1] == 0
    kind = found[0][0] if at_start else declared
    return kind, at_start, kind != declared, found


def sniff(table: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """All columns of ``table`` and its ``sniffed`` type, ``corrected`` (it differs from the declared one), ``embedded`` files and ``trailing`` bytes.

    A value with no valid file at its start keeps its declared type; embedded files are those further in, and where no file is
    at the start, all of them.  A null or empty value has none.  Columns named like the new ones are replaced.
    """
    kept = table.drop("sniffed", "corrected", "embedded", "trailing")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, of = batch.schema.get_field_index(media), batch.schema.get_field_index(declared)
            kinds, wrong, inner, rest = [], [], [], []
            for value, said in zip(batch.column(at), batch.column(of).to_pylist(), strict=True):
                data = value.as_py() or b""
                kind, at_start, differs, found = _sniffed(data, said)
                kinds.append(kind)
                wrong.append(differs)
                inner.append([{"type": k, "start": s, "length": e - s} for k, s, e in found[at_start:]])
                rest.append(len(data) - found[0][2] if at_start else None)
            entry = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
            made = [pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(inner, pa.list_(entry)), pa.array(rest, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "sniffed", "corrected", "embedded", "trailing"])

    from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

    entry = StructType().add("type", StringType()).add("start", LongType()).add("length", LongType())
    schema = StructType(list(kept.schema.fields)).add("sniffed", StringType()).add("corrected", BooleanType()).add("embedded", ArrayType(entry)).add("trailing", LongType())
    return in_batches(kept, run, schema)


def carve(table: DataFrame, media: str = "media") -> DataFrame:
    """A row for each embedded file of sniffed rows: all columns but ``embedded``, and ``type`` and ``content``."""
    each = table.withColumn("_file", F.explode("embedded"))
    content = F.substring(F.col(media), (F.col("_file.start") + 1).cast("int"), F.col("_file.length").cast("int"))
    return each.withColumn("type", F.col("_file.type")).withColumn("content", content).drop("_file", "embedded")


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores each text, sniffs the stored bytes, reads the payload back from the file found there and digests it; see :func:`text_media`.

    ``sniffed`` is the type found, ``corrected`` whether it differs from the declared one, and ``embedded`` and ``embedded_sha256`` are
    the number of media files carved out of the payload and the digest of them all.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = text.as_py() or b""
                stored = store(_padded(raw))
                kind, _, wrong, found = _sniffed(stored, DECLARED)
                if kind != "audio/wav":
                    raise ValueError("a stored text was not recognised")
                payload = samples(stored[: found[0][2]])
                inner = files_in(payload)
                carved = hashlib.sha256(b"".join(payload[s:e] for _, s, e in inner)).hexdigest()
                rows.append((len(raw), len(payload), _sha(payload), zlib.crc32(payload[-16:]), len(stored), _sha(stored), feature(payload), kind, wrong, len(inner), carved))
            columns = zip(*rows, strict=True) if rows else [()] * len(made)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, made.values(), strict=True))], names=["doc_id", *made])

    number, text = pa.int64(), pa.string()
    made = {"n_bytes": number, "payload_bytes": number, "payload_sha256": text, "tail_crc32": number, "media_bytes": number, "media_sha256": text}
    made |= {"feature": text, "sniffed": text, "corrected": pa.bool_(), "embedded": number, "embedded_sha256": text}
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = {number: "bigint", text: "string", pa.bool_(): "boolean"}
    schema = ", ".join([f"doc_id {kind}", *(f"{name} {types[t]}" for name, t in made.items())])
    return in_batches(docs.select("doc_id", F.col("text").cast("string").cast("binary")), run, schema)
