"""Durations, rates and channels from heads made by hand, after the formats' public layouts."""

import struct

import pytest

from tonewell.plans.catalog_readers import made_head
from tonewell.sources import heads, wav


class Bytes:
    """A source in memory that counts what is read."""

    def __init__(self, content):
        self.content, self.size, self.taken = content, len(content), 0

    def read(self, first, size):
        out = self.content[first : first + size]
        self.taken += len(out)
        return out


def probe(content):
    head = heads.probe(Bytes(content))
    return head.rate, head.channels, head.duration


def wave(code, bits, channels, rate, data, extension=b"", wide=False):
    block = bits // 8 * channels
    fmt = struct.pack("<HHIIHH", code, channels, rate, rate * block, block, bits) + extension
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if wide:
        ds = struct.pack("<QQQI", 0, len(data), 0, 0)
        return b"RF64\xff\xff\xff\xffWAVEds64" + struct.pack("<I", len(ds)) + ds + chunks + b"data\xff\xff\xff\xff" + data
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + chunks + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("kind", range(4))
@pytest.mark.parametrize("frames", [1152, 1152 * 100_000])
def test_made_heads(kind, frames):
    rate = 44100 if kind == 2 else 48000
    assert probe(made_head(kind, frames, rate)) == (rate, 2, frames / rate)


def test_wave_codings():
    data = bytes(48_000)
    assert probe(wave(1, 16, 2, 8000, data)) == (8000, 2, 1.5)
    assert probe(wave(1, 24, 2, 8000, data)) == (8000, 2, 1.0)
    assert probe(wave(3, 32, 1, 8000, data)) == (8000, 1, 1.5)
    assert probe(wave(1, 16, 1, 8000, data, wide=True)) == (8000, 1, 3.0)
    extended = struct.pack("<HHIH", 22, 16, 3, 1) + bytes(14)
    head = heads.probe(Bytes(wave(0xFFFE, 16, 2, 8000, data, extended)))
    assert head.layout is not None and head.duration == 1.5
    assert heads.probe(Bytes(wave(3, 32, 1, 8000, data))).layout is None
    with pytest.raises(ValueError, match="unsupported"):
        wav.pcm_layout(wave(1, 24, 2, 8000, data))


def page(packet, position, serial=7, more=0):
    return b"OggS" + struct.pack("<BBqIIIBB", 0, 0, position, serial, more, 0, 1, min(255, len(packet))) + packet


def test_ogg():
    opus = b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 312, 44100, 0, 0)
    assert probe(page(opus, 0) + page(bytes(50), 48312)) == (48000, 1, 1.0)
    # pages that end no packet and those of other streams don't count; sound far behind the head does
    vorbis = b"\x01vorbis" + struct.pack("<IBI", 0, 1, 22050) + bytes(14)
    long = page(vorbis, 0) + page(bytes(255), 44100) + b"\1" * 700_000 + page(bytes(9), -1) + page(bytes(9), 99, serial=8)
    assert probe(long) == (22050, 1, 2.0)
    info = bytes(10) + (16000 << 44 | 15 << 36 | 32000).to_bytes(8, "big") + bytes(16)
    flac = b"\x7fFLAC\1\0\0\1fLaC" + bytes([0, 0, 0, 34]) + info
    assert probe(page(flac, 0)) == (16000, 1, 2.0)
    # a stream of unknown length has it on its last page
    open_ = flac.replace(info, bytes(10) + (16000 << 44 | 15 << 36).to_bytes(8, "big") + bytes(16))
    assert probe(page(open_, 0) + page(bytes(9), 48000)) == (16000, 1, 3.0)
    for bad in (page(b"Speex   ", 0), page(vorbis, -1), b"OggS"):
        with pytest.raises(ValueError):
            probe(bad)


def test_the_last_page_is_found_across_slices():
    vorbis = b"\x01vorbis" + struct.pack("<IBI", 0, 1, 1000) + bytes(14)
    for gap in range(heads.HEAD_BYTES - 40, heads.HEAD_BYTES + 5):
        assert probe(page(vorbis, 0) + page(b"", 5000) + b"\1" * gap)[2] == 5.0


def test_mp3_without_a_count():
    """Bytes over the bit rate; tags at both ends don't count."""
    frame = b"\xff\xfb\x90\xc0" + bytes(413)  # 128 kbit/s at 44,100, one channel
    sound = frame * 100
    assert probe(sound) == (44100, 1, 41700 * 8 / 128000)
    tag = b"ID3\x04\0\0\0\0\1\0" + bytes(128)
    assert probe(tag + sound + b"TAG" + bytes(125)) == probe(sound)
    assert probe(tag + bytes(77) + sound) == probe(sound)


def test_mp3_counts():
    side = b"\xff\xf3\x40\xc0"  # second version, 32 kbit/s at 22,050, one channel
    size = heads.frame_header(side).size
    assert size == 72 * 32000 // 22050 and heads.frame_header(side).samples == 576
    first = (side + bytes(9) + b"Info" + struct.pack(">II", 15, 441)).ljust(size, b"\0")
    assert probe(first + side.ljust(size, b"\0")) == (22050, 1, 441 * 576 / 22050)
    vbri = (b"\xff\xfb\x90\x00" + bytes(32) + b"VBRI" + bytes(10) + struct.pack(">I", 1000)).ljust(417, b"\0")
    assert probe(vbri + b"\xff\xfb\x90\x00") == (44100, 2, 1000 * 1152 / 44100)
    for raw in (b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"abcd", b"\xff"):
        assert heads.frame_header(raw) is None


def box(name, *inside, wide=False):
    size = sum(map(len, inside))
    return (struct.pack(">I", 1) + name + struct.pack(">Q", 16 + size) if wide else struct.pack(">I", 8 + size) + name) + b"".join(inside)


def sound_track(head, rate=44100, handler=b"soun"):
    entry = box(b"mp4a", bytes(16) + struct.pack(">HHHHI", 1, 16, 0, 0, rate << 16))
    return box(
        b"trak", box(b"tkhd", bytes(80)), box(b"mdia", box(b"mdhd", head), box(b"hdlr", bytes(8) + handler + bytes(13)),
        box(b"minf", box(b"smhd", bytes(8)), box(b"stbl", box(b"stsd", bytes(8), entry)))),
    )


def test_m4a():
    narrow = bytes(12) + struct.pack(">III", 600, 1500, 0)
    wide = b"\1" + bytes(19) + struct.pack(">IQ", 44100, 44100 * 5) + bytes(4)
    start = box(b"ftyp", b"M4A \0\0\0\0")
    for moov in (box(b"moov", sound_track(narrow, handler=b"vide"), sound_track(wide)), box(b"moov", sound_track(wide), wide=True)):
        assert probe(start + box(b"mdat", bytes(500), wide=True) + moov) == (44100, 1, 5.0)
        assert probe(start + moov + struct.pack(">I", 0) + b"mdat" + bytes(500)) == (44100, 1, 5.0)
    assert probe(start + box(b"moov", sound_track(narrow))) == (44100, 1, 2.5)
    assert probe(start + box(b"moov", sound_track(wide, rate=0))) == (44100, 1, 5.0)
    for bad in (start, start + box(b"moov", sound_track(wide, handler=b"vide")), start + struct.pack(">I", 999) + b"moov", start + box(b"moov", box(b"trak"))):
        with pytest.raises(ValueError):
            probe(bad)


def test_little_is_read():
    """Only ranges that hold lengths, however long the sound."""
    long = Bytes(made_head(3, 48000, 48000).replace(box(b"mdat", bytes(100)), box(b"mdat", bytes(3_000_000))))
    assert heads.probe(long).duration == 1.0 and long.taken < 10_000
    vorbis = b"\x01vorbis" + struct.pack("<IBI", 0, 1, 1000) + bytes(14)
    ogg = Bytes(page(vorbis, 0) + bytes(3_000_000) + page(b"x", 7000))
    assert heads.probe(ogg).duration == 7.0 and ogg.taken < 3 * heads.HEAD_BYTES


def test_unknown_and_empty():
    for content in (b"", b"RIFF", b"fLaC", b"text of no kind", b"\xff" * 100, b"ID3\x03\0\0\0\0\0\0", b"OggS", b"\0\0\0\x08ftyp"):
        with pytest.raises((ValueError, struct.error)):
            heads.probe(Bytes(content))


def test_scan_takes_all_formats(spark, tmp_path):
    for kind, suffix in enumerate(("flac", "ogg", "mp3", "M4A")):
        (tmp_path / f"x.{suffix}").write_bytes(made_head(kind, 1152 * 50, 44100))
    (tmp_path / "x.wav").write_bytes(wave(1, 24, 2, 44100, bytes(1152 * 50 * 6)))
    (tmp_path / "none.flac").write_bytes(b"x")
    good, bad = wav.scan_corpus(spark, str(tmp_path), minimal=False)
    rows = good.collect()
    assert len(rows) == 5 and {(r["duration"], r["sample_rate"], r["amplitude"]) for r in rows} == {(1152 * 50 / 44100, 44100, None)}
    assert [r["source_file"] for r in bad.collect()] == [f"{tmp_path}/none.flac"]
