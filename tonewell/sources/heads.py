"""Duration, rate and channels of audio files from their heads: WAV, FLAC, Ogg, MP3 and M4A.

Nothing is decoded. A format is told by its first bytes, not by its suffix, and only the
ranges that hold lengths are read: a FLAC's first block, an Ogg's first and last pages,
an MP3's first frame, the boxes of an M4A down to its sound track.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

#: Bytes of a file that are read at first; the data chunk of a WAV nearly always begins there.
HEAD_BYTES = 1 << 16


@dataclass(frozen=True)
class Head:
    """What a scan keeps of a file; ``layout`` is that of PCM samples that can be read."""

    rate: int
    channels: int
    duration: float
    layout: dict | None = None


def wave_layout(content: bytes, length: int) -> dict:
    """Coding, rate, channels, sample width and data range of a WAV file from its head.

    RF64 files have their sizes in a chunk of their own.
    """
    if content[:4] not in (b"RIFF", b"RF64") or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, found, wide = 12, {}, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"ds64":
            wide = struct.unpack("<Q", content[at + 16 : at + 24])[0]
        elif name == b"fmt ":
            code, channels, rate, _, block, bits = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
            if code == 0xFFFE and size >= 40:  # the true coding begins the extension's identifier
                code = struct.unpack("<H", content[at + 32 : at + 34])[0]
            found.update(coding=code, channels=channels, rate=rate, block=block, bits=bits)
        elif name == b"data":
            size = wide if size == 0xFFFFFFFF and wide is not None else size
            found.update(first=at + 8, size=min(size, length - at - 8))
            break
        at += 8 + size + size % 2
    if "block" not in found or "first" not in found:
        raise ValueError("WAV file without format or data")
    if not found["block"] or not found["rate"]:
        raise ValueError("WAV file without a rate")
    return found


def _wave(source) -> Head:
    size = HEAD_BYTES
    while True:
        try:
            layout = wave_layout(source.read(0, min(size, source.size)), source.size)
            break
        except (ValueError, struct.error):
            if size >= source.size:
                raise
            size *= 8
    pcm = layout["coding"] == 1 and layout["bits"] in (16, 32)
    return Head(layout["rate"], layout["channels"], layout["size"] / layout["block"] / layout["rate"], layout if pcm else None)


def _stream_info(block: bytes) -> Head:
    """Rate, channels and samples of a FLAC stream information block."""
    if len(block) < 18:
        raise ValueError("FLAC file cut off")
    packed = int.from_bytes(block[10:18], "big")
    rate, channels, samples = packed >> 44, (packed >> 41 & 7) + 1, packed & ((1 << 36) - 1)
    if not rate or not samples:
        raise ValueError("FLAC file without a length")
    return Head(rate, channels, samples / rate)


def _flac(source, at: int) -> Head:
    block = source.read(at + 4, 4 + 34)
    if not block or block[0] & 0x7F:
        raise ValueError("FLAC file without stream information")
    return _stream_info(block[4:])


def _last_page(source, serial: bytes) -> int:
    """Position of the last page of a stream that ends a packet, searched from the end of the file."""
    end, step, behind = source.size, HEAD_BYTES, b""
    while end > 0:
        first = max(0, end - step)
        part = source.read(first, end - first) + behind
        at = part.rfind(b"OggS", 0, len(part))
        while at >= 0:
            page = part[at : at + 27]
            if len(page) == 27 and page[4] == 0 and page[14:18] == serial:
                position = struct.unpack_from("<q", page, 6)[0]
                if position >= 0:
                    return position
            at = part.rfind(b"OggS", 0, at)
        end, behind = first, part[:26]
        step = min(step * 4, 1 << 22)
    raise ValueError("Ogg stream without a length")


def _ogg(source) -> Head:
    page = source.read(0, HEAD_BYTES)
    if len(page) < 28 or page[4] != 0:
        raise ValueError("bad Ogg page")
    packet, serial = page[27 + page[26] :], page[14:18]
    skip = 0
    if packet[:7] == b"\x01vorbis":
        channels, rate = struct.unpack_from("<BI", packet, 11)
    elif packet[:8] == b"OpusHead":
        channels, skip = struct.unpack_from("<BH", packet, 9)
        rate = 48000  # positions of this coding always count at this rate
    elif packet[:5] == b"\x7fFLAC":
        try:
            return _stream_info(packet[17:])
        except ValueError:
            packed = int.from_bytes(packet[27:35], "big")
            rate, channels = packed >> 44, (packed >> 41 & 7) + 1
    else:
        raise ValueError("unknown coding in an Ogg file")
    if not rate or not channels:
        raise ValueError("Ogg file without a rate")
    return Head(rate, channels, max(0, _last_page(source, serial) - skip) / rate)


# Fixed values of the MPEG audio frame header: kbit/s by (first version, layer), rates by version.
BIT_RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
RATE_DIVISOR = {3: 1, 2: 2, 0: 4}  # version bits: first, second, half of the second


@dataclass(frozen=True)
class Frame:
    first: bool
    layer: int
    kbits: int
    rate: int
    mono: bool
    padded: bool

    @property
    def samples(self) -> int:
        if self.layer == 1:
            return 384
        return 576 if self.layer == 3 and not self.first else 1152

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.kbits * 1000 // self.rate + self.padded) * 4
        return self.samples // 8 * self.kbits * 1000 // self.rate + self.padded


def frame_header(raw: bytes) -> Frame | None:
    """The frame that begins with four bytes, if they are a header."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    kbits, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or kbits in (0, 15) or rate == 3:
        return None
    rates = BIT_RATES[version == 3, layer]
    return Frame(version == 3, layer, rates[kbits - 1], RATES[rate] // RATE_DIVISOR[version], raw[3] >> 6 == 3, bool(raw[2] & 2))


def tag_size(source) -> int:
    """Bytes of the tags at the start of a file."""
    at = 0
    while (head := source.read(at, 10))[:3] == b"ID3" and len(head) == 10:
        size = 0
        for byte in head[6:10]:
            size = size << 7 | byte & 0x7F
        at += 10 + size + (10 if head[5] & 0x10 else 0)
    return at


def _mp3(source, at: int) -> Head:
    """From the number of frames that the first one states, or else from its bit rate and the bytes there are."""
    part = source.read(at, HEAD_BYTES)
    for place in range(len(part) - 3):
        frame = frame_header(part[place : place + 4])
        # two frames in a row, unless the file ends with the first one
        if frame and (place + frame.size + 4 > len(part) or frame_header(part[place + frame.size :][:4])):
            break
    else:
        raise ValueError("no MPEG audio frame found")
    side = (17 if frame.mono else 32) if frame.first else (9 if frame.mono else 17)
    body = part[place : place + 200]
    frames = None
    if body[4 + side : 8 + side] in (b"Xing", b"Info"):
        flags, count = struct.unpack_from(">II", body, 8 + side)
        frames = count if flags & 1 else None
    elif body[36:40] == b"VBRI":
        frames = struct.unpack_from(">I", body, 50)[0]
    channels = 1 if frame.mono else 2
    if frames is not None:
        return Head(frame.rate, channels, frames * frame.samples / frame.rate)
    end = source.size - (128 if source.read(max(0, source.size - 128), 3) == b"TAG" else 0)
    return Head(frame.rate, channels, (end - at - place) * 8 / (frame.kbits * 1000))


def boxes(source, first: int, end: int):
    """``(name, first byte, end)`` of the contents of the boxes in a range."""
    while first + 8 <= end:
        head = source.read(first, 16)
        size, name, skip = struct.unpack_from(">I", head)[0], head[4:8], 8
        if size == 1:
            size, skip = struct.unpack_from(">Q", head, 8)[0], 16
        elif size == 0:  # up to the end
            size = end - first
        if size < skip or first + size > end:
            raise ValueError("bad box in an M4A file")
        yield name, first + skip, first + size
        first += size


def _inside(source, first: int, end: int, *names: bytes):
    """The range of the first box along a path of names, or None."""
    for name in names:
        for found, a, b in boxes(source, first, end):
            if found == name:
                first, end = a, b
                break
        else:
            return None
    return first, end


def _timed(raw: bytes) -> tuple[int, int]:
    """(units a second, length) of a box with times of 32 or 64 bits."""
    return struct.unpack_from(">IQ", raw, 20) if raw[:1] == b"\x01" else struct.unpack_from(">II", raw, 12)


def _m4a(source) -> Head:
    movie = _inside(source, 0, source.size, b"moov")
    if movie is None:
        raise ValueError("M4A file without a movie box")
    for name, first, end in boxes(source, *movie):
        if name != b"trak":
            continue
        kind = _inside(source, first, end, b"mdia", b"hdlr")
        if kind is None or source.read(kind[0] + 8, 4) != b"soun":
            continue
        head = _inside(source, first, end, b"mdia", b"mdhd")
        entries = _inside(source, first, end, b"mdia", b"minf", b"stbl", b"stsd")
        if head is None or entries is None:
            raise ValueError("sound track without a head")
        units, length = _timed(source.read(head[0], 32))
        entry = source.read(entries[0] + 8, 36)
        channels, rate = struct.unpack_from(">H", entry, 24)[0], struct.unpack_from(">I", entry, 32)[0] >> 16
        if not units:
            raise ValueError("sound track without a rate")
        return Head(rate or units, channels, length / units)
    raise ValueError("no sound track")


def probe(source) -> Head:
    """The head of any known format; ``source`` has ``size`` and ``read(first, size)``."""
    start = source.read(0, 12)
    if start[:4] in (b"RIFF", b"RF64"):
        return _wave(source)
    if start[:4] == b"OggS":
        return _ogg(source)
    if start[4:8] == b"ftyp":
        return _m4a(source)
    at = tag_size(source)
    if source.read(at, 4) == b"fLaC":
        return _flac(source, at)
    if at or start[:1] == b"\xff":
        return _mp3(source, at)
    raise ValueError("unknown audio format")
