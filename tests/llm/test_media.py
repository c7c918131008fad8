from __future__ import annotations

import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import media as m


def padded(text):
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % 192 or (0 if raw else 192))


@given(st.integers(1, 300), st.integers(0, 2**32))
@settings(max_examples=40, deadline=None)
def test_round_trip_of_frames(frames, seed):
    raw = hashlib.sha256(str(seed).encode()).digest() * (6 * frames)
    stored = m.write_gray_video(raw)
    (track,) = m.read_tracks(stored)
    assert m.payload(stored, track) == raw
    assert (track.codec, track.width, track.height, track.duration, len(track.sizes)) == ("raw ", 16, 12, frames, frames)
    assert track.keyframes == list(range(0, frames, m.KEYFRAME_EVERY))
    for (at, n), k in zip(track.keyframe_ranges(), track.keyframes):
        assert stored[at : at + n] == raw[192 * k : 192 * k + 192]


def test_digests_match_the_payload(spark, docs_of):
    texts = ["", None, "a", "é" * 95 + "xx", "x" * 192, "y" * 193, "long " * 20000, "a"]
    got = {r.doc_id: r for r in m.digest_media(m.store_texts(docs_of(texts))).collect()}
    for i, t in enumerate(texts):
        raw, r = padded(t), got[i]
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(raw))
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.tail_crc32 == zlib.crc32(raw[-16:])
        assert r.media_sha256 == hashlib.sha256(m.write_gray_video(raw)).hexdigest()
    assert got[2][1:] == got[7][1:]


def test_damaged_containers_have_a_reason(spark):
    good = m.write_gray_video(b"x" * 384)
    cases = [(0, good), (1, None), (2, b""), (3, good[:100]), (4, b"\0\0\0\x05abcd"), (5, good[:-400] if len(good) > 400 else b""), (6, b"\0\0\0\x08free")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, "s") for i, b in cases], "doc_id long, media binary, status string")
    got = {r.doc_id: r for r in m.index_media(df).collect()}
    assert len(got) == len(cases) and got[0].status == "ok" and got[0].n_samples == 2
    assert got[0].keyframes[0].length == 192 and got[0].duration_s == pytest.approx(2 / 25)
    assert all(got[i].status != "ok" and got[i].codec is None for i in range(1, 7))


def test_variable_sizes_compact_sizes_and_long_boxes():
    def box(kind, body, long=False):
        return struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body if long else struct.pack(">I4s", 8 + len(body), kind) + body

    sizes, data = [3, 5, 7, 1], b"aaabbbbbcccccccd"
    full = lambda kind, body: box(kind, bytes(4) + body)
    for stsz in (full(b"stsz", struct.pack(">6I", 0, 4, *sizes)), full(b"stz2", bytes(3) + b"\x08" + struct.pack(">I4B", 4, *sizes)), full(b"stz2", bytes(3) + b"\x04" + struct.pack(">I", 4) + bytes([0x35, 0x71]))):
        def movie(first):
            stbl = box(b"stbl", stsz + full(b"stsc", struct.pack(">I6I", 2, 1, 1, 1, 2, 3, 1)) + full(b"stco", struct.pack(">3I", 2, first, first + 3)) + full(b"stts", struct.pack(">3I", 1, 4, 10)))
            mdia = box(b"mdia", full(b"mdhd", struct.pack(">4I", 0, 0, 10, 0) + bytes(4)) + box(b"minf", stbl))
            return box(b"moov", box(b"trak", mdia), long=True)

        front = len(movie(0)) + 8
        stored = movie(front) + box(b"mdat", data)
        (track,) = m.read_tracks(stored)
        assert m.payload(stored, track) == data and track.sizes == sizes and track.duration == 40
        assert track.keyframes == [0, 1, 2, 3]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, flags, *parts):
    return box(kind, struct.pack(">I", flags), *parts)


def fragmented(header_flags, trun_flags, sizes, data_offset=True):
    """Two fragments of two samples each; only each fragment's first sample is a keyframe."""
    tkhd = full(b"tkhd", 3, struct.pack(">III", 0, 0, 7))
    mdia = box(b"mdia", full(b"mdhd", 0, struct.pack(">5I", 0, 0, 10, 0, 0)), full(b"hdlr", 0, bytes(4), b"vide", bytes(13)), box(b"minf", box(b"stbl", full(b"stsd", 0, struct.pack(">I", 1), box(b"avc1", bytes(78))))))
    moov = box(b"moov", box(b"trak", tkhd, mdia), box(b"mvex", full(b"trex", 0, struct.pack(">5I", 7, 1, 3, 4, 0x10000))))
    out, want = moov, []
    for a, b in (sizes[:2], sizes[2:]):
        def moof(offset):
            head = full(b"tfhd", header_flags, struct.pack(">I", 7))
            rows = b"".join(struct.pack(">I", n) for n in (a, b)) if trun_flags & 0x200 else b""
            return box(b"moof", full(b"mfhd", 0, bytes(4)), box(b"traf", head, full(b"trun", trun_flags | 1, struct.pack(">Ii", 2, offset), struct.pack(">I", 0) if trun_flags & 4 else b"", rows)))

        at = len(out) + len(moof(0)) + 8
        want += [(at, a), (at + a, b)]
        out += moof(at - len(out)) + box(b"mdat", bytes(range(a + b)))
    return out, want


@pytest.mark.parametrize("flags, sizes", [(0x4, [4, 4, 4, 4]), (0x204, [5, 1, 2, 9])])
def test_fragments_are_decoded(flags, sizes):
    stored, want = fragmented(0x20000, flags, sizes)
    (track,) = m.read_tracks(stored)
    assert (track.codec, list(zip(track.offsets, track.sizes)), track.keyframes, track.duration) == ("avc1", want, [0, 2], 12)
    assert m.payload(stored, track) == b"".join(stored[a : a + n] for a, n in want)


def test_any_damage_is_a_media_error():
    """Cut anywhere, or with any byte changed, a file gives tracks or a MediaError, nothing else."""
    import random

    r = random.Random(3)
    for good in (m.write_gray_video(b"x" * 1920), fragmented(0x20000, 0x204, [5, 1, 2, 9])[0]):
        front = good[:-1800] if len(good) > 2000 else good
        cases = [front[:n] for n in range(len(front))]
        for _ in range(4000):
            bad = bytearray(good)
            for _ in range(r.choice([1, 1, 2, 8])):
                bad[r.randrange(min(len(bad), 900))] = r.choice([0, 1, 255, r.randrange(256)])
            cases.append(bytes(bad))
        for case in cases:
            try:
                m.read_tracks(case)
            except m.MediaError:
                pass
    # An mdhd without a byte, and one too short for its fields.
    for body in (b"", bytes(4), b"\1" + bytes(20)):
        with pytest.raises(m.MediaError):
            m.read_tracks(box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", body)))))


def test_deep_nesting():
    stored = b""
    for _ in range(20_000):
        stored = struct.pack(">I4s", 8 + len(stored), b"udta") + stored if len(stored) < 160_000 else stored
    assert len(m.read_tracks(box(b"moov", box(b"trak", stored)))) == 1


def test_the_video_track_is_indexed(spark):
    sound = box(b"trak", box(b"mdia", full(b"hdlr", 0, bytes(4), b"soun", bytes(13))))
    stored = fragmented(0x20000, 0x4, [4] * 4)[0]
    both = bytearray(stored)
    (size,) = struct.unpack_from(">I", stored)
    both[8:8] = sound
    both[:4] = struct.pack(">I", size + len(sound))
    df = spark.createDataFrame([(1, bytes(both))], "doc_id long, media binary")
    assert [(r.codec, r.n_samples) for r in m.index_media(df).collect()] == [("avc1", 4)]


def test_empty_table(docs_of):
    assert m.digest_media(m.store_texts(docs_of([]))).collect() == []
