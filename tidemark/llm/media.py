"""ISO base media containers (ISO/IEC 14496-12): box walk, sample tables, keyframe byte ranges.

Payloads are never decoded: a track's samples are located by its sample tables (stts, stsc, stsz or stz2, stco or co64,
stss) and by the runs of movie fragments (moof, traf, trun), and read as byte ranges. Every read is bounded by its box.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_column, map_batches, table

#: Boxes whose payload is a list of boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"})
FRAME_BYTES, FRAMES_A_CHUNK, KEYFRAME_EVERY, WIDTH, HEIGHT, TIMESCALE = 192, 64, 25, 16, 12, 25


class MediaError(ValueError):
    """The bytes are not a well-formed container."""


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, payload start, payload end) of each box in data[start:end]."""
    while start < end:
        if end - start < 8:
            raise MediaError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise MediaError(f"a long box at {start} has no size")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise MediaError(f"box {kind!r} at {start} has size {size}")
        yield kind, start + head, start + size
        start += size


def leaves(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """The boxes below data[start:end] that hold no boxes, at any depth, in the order of the file."""
    inside = [boxes(data, start, end)]
    while inside:
        for kind, a, b in inside[-1]:
            if kind in CONTAINERS:
                inside.append(boxes(data, a, b))
                break
            yield kind, a, b
        else:
            inside.pop()


def _unpack(fmt: str, data: memoryview, at: int, end: int) -> tuple:
    """Values at ``at`` of a box that ends at ``end``."""
    if at + struct.calcsize(fmt) > end:
        raise MediaError("a box is cut short")
    return struct.unpack_from(fmt, data, at)


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    handler: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    sizes: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    keyframes: list[int] = field(default_factory=list)  # sample numbers from 0

    def ranges(self) -> list[tuple[int, int]]:
        """The samples' bytes in decoding order, neighbours joined: (offset, length)."""
        out: list[tuple[int, int]] = []
        for at, size in zip(self.offsets, self.sizes):
            if out and out[-1][0] + out[-1][1] == at:
                out[-1] = (out[-1][0], out[-1][1] + size)
            else:
                out.append((at, size))
        return out

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        return [(self.offsets[k], self.sizes[k]) for k in self.keyframes]


def _table(data: memoryview, at: int, end: int, fmt: str, skip: int = 4) -> list[tuple]:
    """The entries of a full box that holds a count and then rows of ``fmt``."""
    if end - at < skip + 4:
        raise MediaError("a table is cut short")
    (count,) = struct.unpack_from(">I", data, at + skip)
    at += skip + 4
    if count * struct.calcsize(fmt) > end - at:
        raise MediaError(f"a table of {count} rows is cut short")
    return list(struct.iter_unpack(fmt, data[at : at + count * struct.calcsize(fmt)]))


def _sizes(data: memoryview, kind: bytes, at: int, end: int) -> list[int]:
    if end - at < 12:
        raise MediaError("a size table is cut short")
    if kind == b"stsz":
        fixed, count = struct.unpack_from(">II", data, at + 4)
        if fixed:
            if count * fixed > len(data):
                raise MediaError("the samples are larger than the file")
            return [fixed] * count
        return [x for (x,) in _table(data, at, end, ">I", 8)]
    bits, count = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    raw = bytes(data[at + 12 : end])
    if bits not in (4, 8, 16) or count * bits > 8 * len(raw):
        raise MediaError("a compact size table is cut short")
    if bits == 4:
        return [raw[i // 2] >> 4 if i % 2 == 0 else raw[i // 2] & 15 for i in range(count)]
    return list(struct.unpack(f">{count}{'B' if bits == 8 else 'H'}", raw[: count * bits // 8]))


def _sample_offsets(chunks: list[int], runs: list[tuple], sizes: list[int]) -> list[int]:
    """Each sample's place from chunk offsets and (first chunk, samples a chunk, description) runs."""
    out: list[int] = []
    for i, (first, per, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)
        if not 1 <= first <= last + 1 or last > len(chunks):
            raise MediaError("sample-to-chunk runs are out of order")
        for c in range(first - 1, last):
            at = chunks[c]
            for _ in range(per):
                if len(out) == len(sizes):
                    return out
                out.append(at)
                at += sizes[len(out) - 1]
    if len(out) != len(sizes):
        raise MediaError(f"{len(sizes)} samples, {len(out)} with a place")
    return out


def _track(data: memoryview, start: int, end: int) -> Track:
    track, found = Track(), {}
    for kind, a, b in leaves(data, start, end):
        found.setdefault(kind, (a, b))
    if b"tkhd" in found:
        at, to = found[b"tkhd"]
        (track.number,) = _unpack(">I", data, at + (20 if _unpack(">B", data, at, to)[0] == 1 else 12), to)
    if b"mdhd" in found:
        at, to = found[b"mdhd"]
        track.timescale, track.duration = _unpack(">IQ", data, at + 20, to) if _unpack(">B", data, at, to)[0] == 1 else _unpack(">II", data, at + 12, to)
    if b"hdlr" in found:
        at, to = found[b"hdlr"]
        track.handler = _unpack(">4s", data, at + 8, to)[0].decode("latin-1")
    if b"stsd" in found:
        at, to = found[b"stsd"]
        for kind, a, b in boxes(data, at + 8, to):
            track.codec = kind.decode("latin-1")
            if track.handler == "vide" and b - a >= 28:
                track.width, track.height = struct.unpack_from(">HH", data, a + 24)
            break
    kind = b"stsz" if b"stsz" in found else b"stz2"
    if kind in found:
        track.sizes = _sizes(data, kind, *found[kind])
        places = [x for (x,) in _table(data, *found[b"stco"], ">I")] if b"stco" in found else [x for (x,) in _table(data, *found[b"co64"], ">Q")] if b"co64" in found else []
        track.offsets = _sample_offsets(places, _table(data, *found[b"stsc"], ">III") if b"stsc" in found else [], track.sizes)
    if b"stts" in found and not track.duration:
        track.duration = sum(n * d for n, d in _table(data, *found[b"stts"], ">II"))
    track.keyframes = [k - 1 for (k,) in _table(data, *found[b"stss"], ">I") if 0 < k <= len(track.sizes)] if b"stss" in found else list(range(len(track.sizes)))
    return track


#: A sample's flag that it depends on others.
NOT_SYNC = 0x10000


def _fragment(data: memoryview, box: int, start: int, end: int, tracks: dict[int, Track], defaults: dict[int, tuple[int, int, int]]) -> None:
    """Add the samples of one moof, a box that begins at ``box``, to their tracks."""
    at_end = box  # where the data of the run before ends
    for kind, a, b in boxes(data, start, end):
        if kind != b"traf":
            continue
        track, base, own = None, at_end, (0, 0, 0)
        for part, x, to in boxes(data, a, b):
            if part == b"tfhd":
                word, number = _unpack(">II", data, x, to)
                flags, at = word & 0xFFFFFF, x + 8
                track, own = tracks.get(number), defaults.get(number, (0, 0, 0))
                if flags & 0x1:
                    (base,), at = _unpack(">Q", data, at, to), at + 8
                elif flags & 0x20000:
                    base = box
                at += 4 * bool(flags & 0x2)
                own = list(own)
                for i, bit in enumerate((0x8, 0x10, 0x20)):
                    if flags & bit:
                        (own[i],), at = _unpack(">I", data, at, to), at + 4
                at_end = base
            elif part == b"trun":
                if track is None:
                    raise MediaError("a run belongs to no track")
                word, count = _unpack(">II", data, x, to)
                flags, at, place = word & 0xFFFFFF, x + 8, at_end
                if flags & 0x1:
                    (offset,), at = _unpack(">i", data, at, to), at + 4
                    place = base + offset
                first = None
                if flags & 0x4:
                    (first,), at = _unpack(">I", data, at, to), at + 4
                fields = [bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800)]
                if count * max(4 * sum(fields), 0 if fields[1] else own[1], 1) > len(data):
                    raise MediaError(f"a run of {count} samples is cut short")
                values = iter(_unpack(f">{count * sum(fields)}I", data, at, to))
                for n in range(count):
                    duration, size, sample = (next(values) if f else o for f, o in zip(fields[:3], own))
                    if fields[3]:
                        next(values)
                    if not (first if n == 0 and first is not None and not fields[2] else sample) & NOT_SYNC:
                        track.keyframes.append(len(track.sizes))
                    track.sizes.append(size)
                    track.offsets.append(place)
                    track.duration += duration
                    place += size
                at_end = place


def read_tracks(stored: bytes) -> list[Track]:
    """The tracks of a container, samples of movie fragments included; MediaError if its boxes or tables are damaged."""
    data, out = memoryview(stored), []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments = []
    try:
        box = 0
        for kind, a, b in boxes(data, 0, len(data)):
            if kind == b"moov":
                for k, x, y in boxes(data, a, b):
                    if k == b"trak":
                        out.append(_track(data, x, y))
                    elif k == b"mvex":
                        for part, u, v in boxes(data, x, y):
                            if part == b"trex":
                                number, _, *own = _unpack(">5I", data, u + 4, v)
                                defaults[number] = tuple(own)
            elif kind == b"moof":
                fragments.append((box, a, b))
            box = b
        tracks = {t.number: t for t in out}
        for fragment in fragments:
            _fragment(data, *fragment, tracks, defaults)
    except (struct.error, OverflowError) as e:
        raise MediaError(str(e)) from e
    for track in out:
        for at, size in zip(track.offsets, track.sizes):
            if at < 0 or at + size > len(data):
                raise MediaError("a sample lies outside the file")
    return out


def payload(stored: bytes, track: Track) -> bytes:
    return b"".join(stored[a : a + n] for a, n in track.ranges())


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_gray_video(raw: bytes) -> bytes:
    """A container with one track of uncompressed 8-bit grey frames of 16 x 12 samples that hold ``raw`` as it is."""
    frames = len(raw) // FRAME_BYTES
    if frames * FRAME_BYTES != len(raw) or not frames:
        raise MediaError("the payload is no positive multiple of a frame")
    chunks = -(-frames // FRAMES_A_CHUNK)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    keys = range(1, frames + 1, KEYFRAME_EVERY)
    rest = frames - (chunks - 1) * FRAMES_A_CHUNK
    runs = [(1, FRAMES_A_CHUNK, 1)] * (chunks > 1) + [(chunks, rest, 1)] * (chunks == 1 or rest != FRAMES_A_CHUNK)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(first: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME_BYTES, frames)),
            _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *(first + c * FRAMES_A_CHUNK * FRAME_BYTES for c in range(chunks)))),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, frames), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    front = len(ftyp) + len(moov(0)) + 16
    return b"".join((ftyp, moov(front), struct.pack(">I4sQ", 1, b"mdat", 16 + len(raw)), raw))


INDEX_SCHEMA = "status string, codec string, width int, height int, duration_s double, n_samples long, keyframes array<struct<start:long,length:long>>"


def index_media(df: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """``key`` and the index of each container in the binary ``column``: codec, frame size, duration and keyframe byte
    ranges of its first video track, or without one of its first track. A null or damaged container has its reason in
    ``status`` and nulls else; so has one without a track. One row for each row; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def make():
        def one(stored):
            if stored is None:
                return ("no media", None, None, None, None, None, None)
            try:
                tracks = read_tracks(bytes(stored))
            except MediaError as e:
                return (str(e), None, None, None, None, None, None)
            if not tracks:
                return ("no track", None, None, None, None, None, None)
            t = next((t for t in tracks if t.handler == "vide"), tracks[0])
            return ("ok", t.codec, t.width, t.height, t.duration / t.timescale if t.timescale else None, len(t.sizes), [{"start": a, "length": n} for a, n in t.keyframe_ranges()])

        names = ["status", "codec", "width", "height", "duration_s", "n_samples", "keyframes"]
        return lambda rows: {"row_key": rows[key], **by_column(names, [one(x) for x in rows[column]])}

    return map_batches(df, [key, column], make, f"row_key {kind}, {INDEX_SCHEMA}").withColumnRenamed("row_key", key)


STORE_SCHEMA = "doc_id long, n_bytes long, media binary"


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text as grey video in a container, padded with spaces to whole frames (null or empty: one frame of spaces)."""

    def make():
        def one(text):
            raw = (text or "").encode()
            return len(raw), write_gray_video(raw + b" " * (-len(raw) % FRAME_BYTES or (0 if raw else FRAME_BYTES)))

        def work(rows):
            done = [one(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_bytes": [n for n, _ in done], "media": [m for _, m in done]}

        return work

    return map_batches(docs, ["doc_id", "text"], make, STORE_SCHEMA)


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<start:long,length:long>>"


def digest_media(stored: DataFrame) -> DataFrame:
    """What can be read back from the stored bytes: payload digests, the container's digest and its features."""

    def make():
        def one(doc_id, n, media):
            media = bytes(media)
            track = read_tracks(media)[0]
            raw, keys = payload(media, track), track.keyframe_ranges()
            feature = f"{track.codec.strip()} {track.width}x{track.height} frames={len(track.sizes)} duration={track.duration}/{track.timescale} keyframes={len(keys)} first={keys[0][0]}+{keys[0][1]} last={keys[-1][0]}+{keys[-1][1]}"
            return (doc_id, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, track.codec, track.duration / track.timescale, [{"start": a, "length": k} for a, k in keys])

        names = [x.split()[0] for x in "doc_id,n_bytes,payload_bytes,payload_sha256,tail_crc32,media_bytes,media_sha256,feature,codec,duration_s,keyframes".split(",")]

        def work(rows):
            return by_column(names, [one(*r) for r in zip(rows["doc_id"], rows["n_bytes"], rows["media"])])

        return work

    return map_batches(stored, ["doc_id", "n_bytes", "media"], make, DIGEST_SCHEMA)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored in a media container and read back; one row a document, no shuffle."""
    return digest_media(store_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")))
