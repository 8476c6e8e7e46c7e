"""MPEG-1 Layer III columns: a lossless byte carrier, and a parser of frames, tags, seek tables and checksums.

The carrier's frames are silent (their side information codes no granule data), so decoders skip what follows it;
the payload stands there as ancillary bytes. The last frame takes the smallest bitrate that holds the rest, hence the
stream has a variable bitrate and opens with an ID3v2 tag and a Xing frame.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsefield.llm.common import map_text

# Fixed values of the format: kbit/s of MPEG-1 and MPEG-2/2.5 by layer, and the sampling rates of MPEG-1.
RATES_1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
RATES_2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
RATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): RATES_1,
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): RATES_2,
    (False, 3): RATES_2,
}
HERTZ = [44100, 48000, 32000]


@dataclass(frozen=True)
class Header:
    size: int
    samples: int
    hertz: int
    kbps: int
    checked: bool
    side: int
    layer: int


@dataclass
class Parsed:
    frames: list[tuple[int, Header]] = field(default_factory=list)
    samples: int = 0
    hertz: int = 0
    bad_checksums: int = 0
    checked: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    toc: bytes = b""

    @property
    def seconds(self) -> float:
        """Of what is heard: without the delay and padding that an encoder states."""
        heard = max(0, self.samples - self.table.get("delay", 0) - self.table.get("padding", 0))
        return heard / self.hertz if self.hertz else 0.0


_known: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if four in _known:
        return _known[four]
    out = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer, rate, hz = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
        if version != 1 and layer < 4 and rate not in (0, 15) and hz != 3:
            one, mono, padded = version == 3, four[3] >> 6 == 3, four[2] >> 1 & 1
            kbps, hertz = RATES[one, layer][rate], HERTZ[hz] >> (0 if one else 1 if version == 2 else 2)
            samples = 384 if layer == 1 else 1152 if one or layer == 2 else 576
            size = (12_000 * kbps // hertz + padded) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + padded
            side = 0 if layer < 3 else (17 if mono else 32) if one else (9 if mono else 17)
            out = Header(size, samples, hertz, kbps, not four[1] & 1, side, layer)
    if len(_known) < 4096:
        _known[four] = out
    return out


_sums: dict[bytes, int] = {}


def checksum(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, start 0xFFFF."""
    if data in _sums:
        return _sums[data]
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    if len(_sums) < 4096:
        _sums[data] = crc
    return crc


def head(kbps: int) -> bytes:
    """Header, checksum and empty side information of a 48 kHz stereo frame."""
    four = bytes([0xFF, 0xFA, RATES_1.index(kbps) << 4 | 1 << 2, 0])
    return four + checksum(four[2:] + bytes(32)).to_bytes(2, "big") + bytes(32)


HEADS = {k: head(k) for k in RATES_1[1:]}
ROOM = {k: 3 * k - 38 for k in HEADS}


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def write(payload: bytes) -> bytes:
    """A playable stream that carries the payload."""
    frames, at = [], 0
    while at < len(payload):
        k = next((k for k, room in ROOM.items() if room >= len(payload) - at), 320)
        frames.append(HEADS[k] + payload[at : at + ROOM[k]].ljust(ROOM[k], b"\0"))
        at += ROOM[k]
    size = 192 + sum(map(len, frames))
    seek, toc = 192, bytearray(100)
    places = []
    for f in frames:
        places.append(seek)
        seek += len(f)
    for i in range(100):
        toc[i] = min(255, 256 * (places[i * len(places) // 100] if places else 0) // size)
    xing = HEADS[64] + b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    text = b"\0payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    return b"ID3\3\0\0" + synchsafe(len(tag)) + tag + xing.ljust(192, b"\0") + b"".join(frames)


def parse(data: bytes) -> Parsed:
    """Tags, tables and frames; junk between frames is skipped up to a header that another frame, or the end, follows."""
    out, at, end = Parsed(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = int.from_bytes(bytes(4), "big")
        for b in data[at + 6 : at + 10]:
            size = size << 7 | b & 127
        k, stop, wide = at + 10, min(end, at + 10 + size), data[at + 3] == 4
        while k + 10 <= stop and data[k]:
            n = 0
            for b in data[k + 4 : k + 8]:
                n = n << (7 if wide else 8) | b
            out.tags[data[k : k + 4].decode("latin-1")] = data[k + 11 : k + 10 + n].decode("latin-1")
            k += 10 + n
        at = stop + 10 * bool(data[at + 5] & 16)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        out.tags["TAG"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    synced = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and at + h.size <= end and (synced or at + h.size == end or header(data[at + h.size : at + h.size + 4])):
            if not out.frames and not out.table and table(data, at, h, out):
                at += h.size
                synced = True
                continue
            if h.checked and h.layer == 3:
                out.checked += 1
                out.bad_checksums += checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
            out.frames.append((at, h))
            out.samples += h.samples
            out.hertz = h.hertz
            at += h.size
            synced = True
        else:
            near = data.find(b"\xff", at + 1, end)
            near = end if near < 0 else near
            out.skipped += near - at
            at, synced = near, False
    return out


def table(data: bytes, at: int, h: Header, out: Parsed) -> bool:
    """Read a Xing, Info or VBRI table, if this frame holds one."""
    k = at + 4 + 2 * h.checked + h.side
    num = lambda i, n=4: int.from_bytes(data[i : i + n], "big")
    if data[k : k + 4] in (b"Xing", b"Info"):
        flags, k = num(k + 4), k + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out.table[name] = num(k)
                k += 4
        if flags & 4:
            out.toc = data[k : k + 100]
            k += 100
        k += 4 * bool(flags & 8)
        if data[k : k + 4] in (b"LAME", b"Lavf", b"Lavc"):
            gap = num(k + 21, 3)
            out.table |= {"delay": gap >> 12, "padding": gap & 4095}
        out.table["flags"] = flags
    elif data[at + 36 : at + 40] == b"VBRI":
        out.table |= {"bytes": num(at + 46), "frames": num(at + 50)}
        n, width = num(at + 54, 2), num(at + 58, 2)
        out.toc = data[at + 62 : at + 62 + n * width]
    return bool(out.table)


def read(data: bytes) -> tuple[bytes, Parsed]:
    """The payload of a stream that write() made, and what parse() found."""
    p = parse(data)
    got = b"".join([data[a + 4 + 2 * h.checked + h.side : a + h.size] for a, h in p.frames])
    return got[: int(p.tags["TXXX"].split("\0")[-1])], p


def pad(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def audio_columns(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), media: bool = False) -> DataFrame:
    """Each text's bytes in an MPEG stream, read back from it: sizes, digests, exact duration and frame seek offsets.

    Null and empty texts are one block of 64 zero bytes; equal texts give equal values; repeated rows stay; an empty
    table gives no rows; other input columns, whatever their names, are not read. media adds the stream itself.
    """
    fields = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("seconds", T.DoubleType()), ("seek", T.ArrayType(T.LongType(), False))]
    if media:
        fields.append(("media", T.BinaryType()))

    def row(t: str | None) -> tuple:
        raw = (t or "").encode()
        stream = write(pad(raw))
        got, p = read(stream)
        seek = [a for a, _ in p.frames]
        what = f"frames={len(seek)};samples={p.samples};us={p.samples * 1_000_000 // p.hertz};crc_ok={p.checked - p.bad_checksums};crc_bad={p.bad_checksums};xing_frames={p.table.get('frames')};toc_crc={zlib.crc32(p.toc)};seek_crc={zlib.crc32(','.join(map(str, seek)).encode())};skipped={p.skipped}"
        out = (len(raw), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), what, p.seconds, seek)
        return (*out, stream) if media else out

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.field("element", pa.int64(), False)), pa.binary()]

    def make():
        return lambda texts: [pa.array(c, k) for c, k in zip(zip(*map(row, texts.to_pylist()), strict=True), kinds, strict=False)]

    return map_text(df, make, fields, text, keep)
