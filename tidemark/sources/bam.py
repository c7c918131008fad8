"""BAM files: a source that splits files and prunes by index, and a sink of sorted, indexed parts.

A task reads a range of virtual offsets (a block's place in the file, then a place in the inflated block). Where the range
doesn't begin at a known record, the first block is found by the chain of block sizes and the first record by the chain of
record headers. A record belongs to the range that holds its beginning, so any cut of a file gives the same records.
With an index beside the file (x.bam.bai or x.bai) a region is read from the chunks that may hold it and from nothing else.

Files are opened by pyarrow's file systems: paths of a mount that executors share, or URIs (file, hdfs, s3, gs).
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .sam import _OPS, RAW, _edit_distance, with_derived

#: Compressed bytes of one task, and bounds of the batches that a task hands over.
SPLIT_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 20, 4096, 4 << 20
#: Records that must follow each other for a record's beginning to be believed, and blocks likewise.
CHAIN_RECORDS, CHAIN_BLOCKS = 8, 3
#: Inflated bytes of a written block. Fixed values of the format follow: the largest block, its head, the empty last block.
BLOCK_BYTES = 65280
LARGEST_BLOCK = 65536
BLOCK_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Fixed values of the index: first bin of each level and the shift of positions to a level's bins; windows of the linear index.
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
WINDOW_SHIFT, SUMMARY_BIN = 14, 37450
NIBBLES = str.maketrans("0123456789abcdef", "=ACMGRSVTWYHKDBN")
HEX = {ord(c): f"{i:x}" for i, c in enumerate("=ACMGRSVTWYHKDBN")} | {ord(c): f"{i:x}" for i, c in enumerate("=acmgrsvtwyhkdbn")}
UP, DOWN = bytes((i + 33) % 256 for i in range(256)), bytes((i - 33) % 256 for i in range(256))
COLUMNS = [x.split()[0] for x in RAW.split(", ")]


def located(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def bam_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the BAM files at a comma-separated list of files and folders, folders' files by name."""
    from pyarrow import fs

    out = []
    for one in filter(None, path.split(",")):
        system, at = located(one)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        if info.type == fs.FileType.Directory:
            scheme = one.split("://")[0] + "://" if "://" in one else ""
            found = system.get_file_info(fs.FileSelector(at))
            out += sorted((scheme + f.path, f.size) for f in found if f.path.endswith(".bam"))
        else:
            out.append((one, info.size))
    return out


class Blocks:
    """A file's gzip blocks by their places; ``bytes_read`` counts what was fetched."""

    FETCH = 1 << 18

    def __init__(self, path: str):
        system, at = located(path)
        self.file = system.open_input_file(at)
        self.size, self.bytes_read, self.start, self.kept = self.file.size(), 0, 0, b""

    def raw(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self.start <= at and at + n <= self.start + len(self.kept)):
            self.start, self.kept = at, self.file.read_at(max(n, min(self.FETCH, self.size - at)), at)
            self.bytes_read += len(self.kept)
        return self.kept[at - self.start : at - self.start + n]

    def length(self, at: int) -> tuple[int, int] | None:
        """(bytes of the block at ``at``, of its head), or None if there is none."""
        head = self.raw(at, 18)
        if len(head) < 18 or head[:4] != BLOCK_HEAD[:4]:
            return None
        extra = struct.unpack_from("<H", head, 10)[0]
        fields, k = self.raw(at + 12, extra), 0
        while k + 6 <= len(fields):
            n = struct.unpack_from("<H", fields, k + 2)[0]
            if fields[k : k + 2] == b"BC" and n == 2:
                size = struct.unpack_from("<H", fields, k + 4)[0] + 1
                return (size, 12 + extra) if size >= 20 + extra and at + size <= self.size else None
            k += 4 + n
        return None

    def inflate(self, at: int) -> tuple[bytes, int]:
        """(data, the next block's place)."""
        found = self.length(at)
        if found is None:
            raise ValueError(f"no gzip block at {at}")
        size, head = found
        return zlib.decompress(self.raw(at, size)[head : size - 8], -15), at + size

    def first(self, at: int, stop: int) -> int | None:
        """The first block that begins in [at, stop)."""
        while at < min(stop, self.size):
            k = self.raw(at, LARGEST_BLOCK + 18).find(BLOCK_HEAD[:4])
            if k < 0:
                at += LARGEST_BLOCK  # the rest of what was looked at is looked at again
                continue
            at += k
            if at >= stop:
                return None
            place = at
            for _ in range(CHAIN_BLOCKS):
                found = self.length(place)
                if found is None:
                    break
                place += found[0]
                if place == self.size:
                    return at
            else:
                return at
            at += 1
        return None


class Stream:
    """Inflated data from a block on; positions count from that block's first byte."""

    def __init__(self, blocks: Blocks, at: int):
        self.blocks, self.next, self.data, self.base, self.end = blocks, at, bytearray(), 0, 0
        self.starts: list[int] = []
        self.places: list[int] = []

    def has(self, upto: int) -> bool:
        while self.end < upto and self.next < self.blocks.size:
            place = self.next
            more, self.next = self.blocks.inflate(place)
            self.starts.append(self.end)
            self.places.append(place)
            self.data += more
            self.end += len(more)
        return self.end >= upto

    def take(self, at: int, n: int) -> bytes:
        return bytes(self.data[at - self.base : at - self.base + n]) if self.has(at + n) else b""

    def virtual(self, at: int) -> int:
        i = bisect.bisect_right(self.starts, at) - 1
        return self.places[i] << 16 | (at - self.starts[i])

    def forget(self, before: int) -> None:
        if before - self.base > 1 << 22:
            del self.data[: before - self.base]
            self.base = before
            i = max(0, bisect.bisect_right(self.starts, before) - 1)
            del self.starts[:i], self.places[:i]


def header(blocks: Blocks) -> tuple[str, list[tuple[str, int]], int]:
    """(text, contigs, virtual offset of the first record)."""
    s = Stream(blocks, 0)
    if s.take(0, 4) != b"BAM\1":
        raise ValueError("no BAM file")
    number = lambda at: struct.unpack("<i", s.take(at, 4))[0]
    n = number(4)
    text, at, contigs = s.take(8, n).rstrip(b"\0").decode(), 12 + n, []
    for _ in range(number(8 + n)):
        n = number(at)
        contigs.append((s.take(at + 4, n - 1).decode(), number(at + 4 + n)))
        at += 8 + n
    return text, contigs, s.virtual(at) if s.has(at + 1) else blocks.size << 16


def _believable(s: Stream, at: int, n_contigs: int) -> int:
    """The length of what may be a record at ``at``, else 0."""
    head = s.take(at, 36)
    if len(head) < 36:
        return 0
    size, ref, pos, l_name, _, _, n_ops, flag, l_seq, mate, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", head)
    if not (-1 <= ref < n_contigs and -1 <= mate < n_contigs and pos >= -1 and mate_pos >= -1 and l_name and l_seq >= 0):
        return 0
    if flag >> 12 or size < 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq:
        return 0
    name = s.take(at + 36, l_name)
    if len(name) < l_name or name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
        return 0
    ops = s.take(at + 36 + l_name, 4 * n_ops)
    return 4 + size if len(ops) == 4 * n_ops and all(c & 15 <= 8 for c in ops[::4]) else 0


def first_record(s: Stream, stop: int, n_contigs: int) -> int | None:
    """Position of the first record that begins in a block before file place ``stop``."""
    at = 0
    while s.has(at + 1) and s.virtual(at) >> 16 < stop:
        place = at
        for _ in range(CHAIN_RECORDS):
            n = _believable(s, place, n_contigs)
            if not n:
                break
            place += n
            if not s.has(place + 1):
                break
        else:
            return at
        if n and s.end == place:
            return at
        at += 1
    return None


@dataclass
class Range(InputPartition):
    """A task's part of a file: records that begin in virtual offsets [begin, end); ``base`` numbers files' bytes on."""

    path: str
    base: int
    begin: int
    end: int
    known: bool
    region: tuple[str, int, int] | None = None


def _reference_span(ops: tuple[int, ...]) -> int:
    return sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8))


def records(blocks: Blocks, part: Range) -> Iterator[tuple]:
    """Rows of RAW that the range holds."""
    _, contigs, top = header(blocks)
    begin = max(part.begin, top)
    if begin >= part.end:
        return
    if part.known or begin == top:
        s, at = Stream(blocks, begin >> 16), begin & 0xFFFF
    else:
        place = blocks.first(begin >> 16, (part.end + 0xFFFF) >> 16)
        if place is None:
            return
        s = Stream(blocks, place)
        at = first_record(s, (part.end + 0xFFFF) >> 16, len(contigs))
        if at is None:
            return
    name = lambda i: contigs[i][0] if i >= 0 else "*"
    while s.has(at + 4):
        order = s.virtual(at)
        if order >= part.end:
            return
        (size,) = struct.unpack("<i", s.take(at, 4))
        r = s.take(at + 4, size)
        if size < 32 or len(r) < size:
            raise ValueError(f"{part.path} ends within a record")
        at += 4 + size
        s.forget(at)
        ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", r)
        p = 32 + l_name
        ops = struct.unpack_from(f"<{n_ops}I", r, p)
        if part.region:
            contig, low, high = part.region
            if name(ref) != contig or pos + 1 > high or pos + max(_reference_span(ops), 1) < low:
                continue
        p += 4 * n_ops
        seq = r[p : p + (l_seq + 1) // 2].hex().translate(NIBBLES)[:l_seq]
        p += (l_seq + 1) // 2
        qual = r[p : p + l_seq]
        quality = "*" if not l_seq or qual[0] == 255 else qual.translate(UP).decode("latin-1")
        cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in ops) or "*"
        yield ((part.base << 16) + order, r[32 : 31 + l_name].decode(), flag, name(ref), pos + 1, mapq, cigar, name(mate), mate_pos + 1, tlen, seq or "*", quality, _edit_distance(r[p + l_seq :]))


def bins_of(low: int, high: int) -> list[int]:
    """Bins that may hold what overlaps the zero-based positions [low, high]."""
    top = (1 << 29) - 1
    return [first + i for first, shift in LEVELS for i in range(min(low, top) >> shift, (min(high, top) >> shift) + 1)]


def bin_of(low: int, high: int) -> int:
    """The smallest bin that holds the zero-based positions [low, high] whole."""
    return next(first + (low >> shift) for first, shift in reversed(LEVELS) if low >> shift == high >> shift or not shift - 29)


def index_of(path: str) -> bytes | None:
    """The index beside a file."""
    from pyarrow import fs

    for candidate in (path + ".bai", path.removesuffix(".bam") + ".bai"):
        system, at = located(candidate)
        if system.get_file_info(at).type == fs.FileType.File:
            with system.open_input_file(at) as f:
                return f.read()
    return None


def chunks(index: bytes, ref: int, low: int, high: int) -> list[tuple[int, int]]:
    """Merged ranges of virtual offsets that hold all that overlaps positions [low, high] (from 1) of contig number ``ref``."""
    if index[:4] != b"BAI\1":
        raise ValueError("no BAM index")
    low, high = max(low - 1, 0), max(high - 1, 0)
    (n_ref,), at, wanted, found = struct.unpack_from("<i", index, 4), 8, set(bins_of(low, high)), []
    for i in range(n_ref):
        (n_bins,) = struct.unpack_from("<i", index, at)
        at += 4
        for _ in range(n_bins):
            number, n = struct.unpack_from("<Ii", index, at)
            if i == ref and number in wanted:
                flat = struct.unpack_from(f"<{2 * n}Q", index, at + 8)
                found += zip(flat[::2], flat[1::2])
            at += 8 + 16 * n
        (n_windows,) = struct.unpack_from("<i", index, at)
        if i == ref:
            window = low >> WINDOW_SHIFT
            windows = struct.unpack_from(f"<{n_windows}Q", index, at + 4)
            # Beyond the last window nothing begins or reaches; an empty window is 0 in some files: then the one before.
            least = next((w for w in reversed(windows[: window + 1]) if w), 0)
            merged: list[tuple[int, int]] = []
            for a, b in sorted((max(a, least), b) for a, b in found if b > least):
                # Chunks of neighbouring blocks are one range.
                if merged and a >> 16 <= (merged[-1][1] >> 16) + LARGEST_BLOCK:
                    merged[-1] = merged[-1][0], max(b, merged[-1][1])
                else:
                    merged.append((a, b))
            return merged
        at += 4 + 8 * n_windows
    return []


class BamReader(DataSourceReader):
    """Options: path (files and folders, comma-separated), split_bytes, contig, start and stop."""

    def __init__(self, options: dict):
        self.files = bam_files(options.get("path", ""))
        self.split = max(1, int(options.get("split_bytes", SPLIT_BYTES)))
        contig = options.get("contig")
        self.region = (contig, int(options.get("start") or 1), int(options.get("stop") or 1 << 31)) if contig else None
        self.pushed: tuple[str, int, int] | None = None

    def _narrowed(self) -> tuple[str, int, int] | None:
        if self.region and self.pushed and self.region[0] == self.pushed[0]:
            return self.region[0], max(self.region[1], self.pushed[1]), min(self.region[2], self.pushed[2])
        return self.region or self.pushed

    def partitions(self):
        out, base, asked = [], 0, self._narrowed()
        for path, size in self.files:
            spans = [(0, size << 16)]
            index = index_of(path) if asked else None
            if index is not None:
                names = [c[0] for c in header(Blocks(path))[1]]
                spans = chunks(index, names.index(asked[0]), *asked[1:]) if asked[0] in names else []
            for begin, end in spans:
                edges = [begin, *(c << 16 for c in range((begin >> 16) + self.split, (end + 0xFFFF) >> 16, self.split)), end]
                out += [Range(path, base, a, b, k == 0, asked) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            base += size
        return out or [Range("", 0, 0, 0, True)]

    def read(self, partition: Range):
        import pyarrow as pa

        if not partition.path:
            return
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in RAW.split(", ")])
        rows, size = [], 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for row in records(Blocks(partition.path), partition):
            rows.append(row)
            size += len(row[10]) + len(row[11]) + 100
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield make()
                rows, size = [], 0
        if rows:
            yield make()


class PushingReader(BamReader):
    """Filters on contig (equality) and aln_start choose chunks too; Spark applies them to the rows again.

    Spark refuses readers that push filters unless spark.sql.python.filterPushdown.enabled is true: option push says that it is.
    """

    def pushFilters(self, filters):
        contig, low, high = None, 1, 1 << 31
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("contig",):
                contig = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("aln_start",):
                low, high = max(low, f.value), min(high, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("aln_start",):
                low = max(low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("aln_start",):
                high = min(high, f.value - isinstance(f, LessThan))
        if contig is not None and contig != "*":
            self.pushed = contig, low, high
        return filters


def encode(row, ref: int, mate: int) -> tuple[bytes, int, int]:
    """(a record's bytes, first and last zero-based position on its contig)."""
    cigar = [] if row.cigar in (None, "*") else row.cigar
    ops, n = [], 0
    for c in cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            ops.append(n << 4 | _OPS.index(c))
            n = 0
    if len(ops) > 0xFFFF:
        raise ValueError(f"{row.qname}: over 65535 operations")
    name, pos = (row.qname or "*").encode() + b"\0", (row.aln_start or 0) - 1
    if len(name) > 255:
        raise ValueError(f"{row.qname}: a name of over 254 bytes")
    seq = "" if row.seq in (None, "*") else row.seq
    digits = "".join(HEX.get(ord(c), "f") for c in set(seq)) and seq.translate(HEX | {ord(c): "f" for c in set(seq) if ord(c) not in HEX})
    packed = bytes.fromhex(digits + "0" * (len(digits) % 2))
    qual = b"\xff" * len(seq) if row.qual in (None, "*") or len(row.qual) != len(seq) else row.qual.encode("latin-1").translate(DOWN)
    last = pos + max(_reference_span(tuple(ops)), 1) - 1
    number = bin_of(max(pos, 0), max(last, 0)) if pos >= 0 else 4680
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), row.mapq or 0, number, len(ops), row.flag or 0, len(seq), mate, (row.mate_start or 0) - 1, row.tlen or 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + (b"" if row.nm is None else b"NMi" + struct.pack("<i", row.nm))
    return struct.pack("<i", len(body)) + body, pos, last


def block_of(data: bytes) -> bytes:
    for level in (6, 0):
        body = zlib.compressobj(level, zlib.DEFLATED, -15)
        raw = body.compress(data) + body.flush()
        if len(raw) + 26 <= LARGEST_BLOCK:
            return BLOCK_HEAD + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data), len(data))
    raise ValueError("a block is too large")


def header_bytes(contigs: list[tuple[str, int]]) -> bytes:
    text = "\n".join(["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{n}\tLN:{s}" for n, s in contigs)]).encode() + b"\n"
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    return out + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in contigs)


class Index:
    """The index of a file being written; it holds bins, windows and chunks, no records."""

    def __init__(self, n_contigs: int):
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in range(n_contigs)]
        self.windows: list[list[int]] = [[] for _ in range(n_contigs)]

    def add(self, ref: int, first: int, last: int, begin: int, end: int) -> None:
        spans = self.bins[ref].setdefault(bin_of(first, last), [])
        if spans and spans[-1][1] >> 16 == begin >> 16:
            spans[-1][1] = end
        else:
            spans.append([begin, end])
        windows = self.windows[ref]
        while len(windows) <= last >> WINDOW_SHIFT:
            windows.append(begin if len(windows) >= first >> WINDOW_SHIFT else (windows[-1] if windows else begin))

    def to_bytes(self) -> bytes:
        out = b"BAI\1" + struct.pack("<i", len(self.bins))
        for bins, windows in zip(self.bins, self.windows):
            out += struct.pack("<i", len(bins))
            for number, spans in sorted(bins.items()):
                out += struct.pack("<Ii", number, len(spans)) + b"".join(struct.pack("<QQ", *x) for x in spans)
            out += struct.pack("<i", len(windows)) + struct.pack(f"<{len(windows)}Q", *windows)
        return out


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class BamWriter(DataSourceWriter):
    """Each task writes one whole file and its index under _parts; commit moves those of the attempts that count."""

    def __init__(self, path: str, contigs: list[tuple[str, int]], overwrite: bool):
        from pyarrow import fs

        system, at = located(path)
        if system.get_file_info(at).type != fs.FileType.NotFound:
            if not overwrite:
                raise ValueError(f"{path} is there already")
        self.path, self.contigs, self.overwrite, self.parts = path, contigs, overwrite, f"_parts-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        name, rows, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.bam", 0, None
        system, top = located(self.path)
        index, number = Index(len(self.contigs)), {c[0]: i for i, c in enumerate(self.contigs)}
        held, place = bytearray(), 0

        def flush() -> None:
            nonlocal held, place
            raw = block_of(bytes(held[:BLOCK_BYTES]))
            out.write(raw)
            place += len(raw)
            del held[:BLOCK_BYTES]

        for row in iterator:
            if out is None:
                system.create_dir(f"{top}/{self.parts}", recursive=True)
                out = system.open_output_stream(f"{top}/{self.parts}/{name}", compression=None)
                held += header_bytes(self.contigs)
                while held:
                    flush()
            ref = number[row.contig] if row.contig not in (None, "*") else -1
            mate = row.contig if row.mate_contig == "=" else row.mate_contig
            raw, first, last = encode(row, ref, number[mate] if mate not in (None, "*") else -1)
            begin = place << 16 | len(held)
            held += raw
            while len(held) >= BLOCK_BYTES:
                flush()
            if ref >= 0 and first >= 0:
                index.add(ref, first, last, begin, place << 16 | len(held))
            rows += 1
        if out is None:
            return Written(None, 0)
        while held:
            flush()
        out.write(LAST_BLOCK)
        out.close()
        with system.open_output_stream(f"{top}/{self.parts}/{name}.bai", compression=None) as f:
            f.write(index.to_bytes())
        return Written(name, rows)

    def commit(self, messages) -> None:
        system, top = located(self.path)
        if self.overwrite:
            from pyarrow import fs

            if system.get_file_info(top).type == fs.FileType.Directory:
                for f in system.get_file_info(fs.FileSelector(top)):
                    if f.type == fs.FileType.File and f.path.endswith((".bam", ".bai")):
                        system.delete_file(f.path)
        system.create_dir(top, recursive=True)
        for m in messages:
            if m is not None and m.name:
                for name in (m.name, m.name + ".bai"):
                    system.move(f"{top}/{self.parts}/{name}", f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, top = located(self.path)
        if system.get_file_info(f"{top}/{self.parts}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.parts}")


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)`` and ``df.write.format("bam")``, after ``spark.dataSource.register(BamSource)``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> BamReader:
        return (PushingReader if self.options.get("push") == "true" else BamReader)(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        contigs = [(n, int(s)) for n, s in (x.rsplit("\t", 1) for x in self.options.get("contigs", "").split("\n") if x)]
        return BamWriter(self.options["path"], contigs, overwrite)


def bam_contigs(path: str) -> list[tuple[str, int]]:
    """(name, size) of the contigs of the first file's header."""
    files = bam_files(path)
    return header(Blocks(files[0][0]))[1] if files else []


def read_bam(spark: SparkSession, path: str, contig: str | None = None, start: int | None = None, stop: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads of BAM files, those that overlap contig:start-stop where a contig is given.

    file_ord grows through each file and from file to file, and is unique: the record's virtual offset, after the bytes
    of the files before. A file without an index is read whole for a region. An empty file has no reads; a file that
    ends within a record is an error.
    """
    from ..ship import ship

    ship(spark)
    spark.dataSource.register(BamSource)
    options = {"contig": contig, "start": start, "stop": stop, "split_bytes": split_bytes, "push": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    return with_derived(spark.read.format("bam").options(**{k: v for k, v in options.items() if v is not None}).load(path))


def write_bam(reads: DataFrame, path: str, contigs: list[tuple[str, int]], files: int | None = None, overwrite: bool = False) -> None:
    """Reads as a folder of BAM files, each with its header and index, that are sorted one after the other.

    Rows without a contig come last. ``files`` is their number (else the session's partitions decide): 1 is for small
    regions. Contigs that the list lacks, names over 254 bytes and more than 65,535 operations are errors; missing
    fields are written as the format's blanks. Files are not joined: one writer would have to copy all of them.
    """
    from ..ship import ship

    spark = reads.sparkSession
    ship(spark)
    spark.dataSource.register(BamSource)
    numbers = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(contigs)], "contig string, __ref int")
    last = F.coalesce("__ref", F.lit(len(contigs)))
    order = [last, F.coalesce("aln_start", F.lit(0)), "file_ord"]
    keyed = reads.select(*COLUMNS).join(F.broadcast(numbers), "contig", "left")  # a header's lines
    ranged = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    out = ranged.sortWithinPartitions(*order).select(*COLUMNS)
    out.write.format("bam").mode("overwrite" if overwrite else "append").option("contigs", "\n".join(f"{n}\t{s}" for n, s in contigs)).save(path)
