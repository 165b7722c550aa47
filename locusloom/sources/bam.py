"""BAM files as a Spark data source: ``spark.read.format("bam")``, the columns of :func:`locusloom.sources.text.sam`.

BGZF blocks are gzip members that carry their own size. A file is planned in byte ranges: a range owns the records
that begin in its blocks, except that the first complete record is found by trying: a place is a record's start if a
chain of plausible records follows it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qname string, flag int, chr string, pos long, mapq int, cigar string, mchr string, mpos long, isize long, seq string, qual string, tags string"
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBER = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def blocks(source, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the BGZF blocks from a place on."""
    at = start
    while True:
        source.seek(at)
        head = source.read(18)
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            return
        size = struct.unpack("<H", head[16:18])[0] + 1
        source.seek(at)
        yield at, zlib.decompress(source.read(size), 31)
        at += size


def first_block(source, start: int, size: int) -> int:
    """The place of the first block at or after a byte."""
    at = start
    while at < size:
        source.seek(at)
        data = source.read(1 << 17)
        i = data.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            if data[i + 10 : i + 16] == b"\x06\0BC\x02\0":
                return at + i
            i = data.find(b"\x1f\x8b\x08\x04", i + 1)
        at += max(1, len(data) - 20)
    return size


def read_header(source) -> tuple[list[str], int]:
    """Reference names, and the length of the header in the inflated stream."""
    data, refs = b"", []
    for _, part in blocks(source, 0):
        data += part
        try:
            if data[:4] != b"BAM\1":
                raise ValueError("not a BAM file")
            at = 8 + struct.unpack_from("<i", data, 4)[0]
            n = struct.unpack_from("<i", data, at)[0]
            at += 4
            refs = []
            for _ in range(n):
                size = struct.unpack_from("<i", data, at)[0]
                if at + 8 + size > len(data):
                    raise struct.error
                refs.append(data[at + 4 : at + 3 + size].decode())
                at += 8 + size
            return refs, at
        except struct.error:
            continue
    return refs, len(data)


def plausible(data: bytes, at: int, n_refs: int) -> bool:
    """Whether a chain of records may begin here."""
    seen = 0
    while seen < 3:
        if at + 36 > len(data):
            return seen > 0 or at == len(data)
        size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mref, mpos = struct.unpack_from("<iiiBBHHHiii", data, at)
        if not (32 <= size < 1 << 26 and -1 <= ref < n_refs and pos >= -1 and l_name >= 1 and l_seq >= 0 and -1 <= mref < n_refs and mpos >= -1 and 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size):
            return False
        if at + 36 + l_name <= len(data) and data[at + 35 + l_name] != 0:
            return False
        at, seen = at + 4 + size, seen + 1
    return True


def decode(data: bytes, at: int, refs: list[str]) -> dict:
    size, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mref, mpos, isize = struct.unpack_from("<iiiBBHHHiiii", data, at)
    end, p = at + 4 + size, at + 36
    name = data[p : p + l_name - 1].decode("latin-1")
    p += l_name
    ops = struct.unpack_from(f"<{n_cigar}I", data, p)
    p += 4 * n_cigar
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in data[p : p + (l_seq + 1) // 2])[:l_seq]
    p += (l_seq + 1) // 2
    qual = data[p : p + l_seq]
    p += l_seq
    tags = []
    while p + 3 <= end:
        tag, kind = data[p : p + 2].decode("latin-1"), chr(data[p + 2])
        p += 3
        if kind in NUMBER:
            value = struct.unpack_from("<" + NUMBER[kind], data, p)[0]
            p += struct.calcsize(NUMBER[kind])
            kind = "f" if kind == "f" else "i"
        elif kind == "A":
            value, p = chr(data[p]), p + 1
        elif kind in "ZH":
            stop = data.index(b"\0", p)
            value, p = data[p:stop].decode("latin-1"), stop + 1
        else:
            sub, n = chr(data[p]), struct.unpack_from("<i", data, p + 1)[0]
            value = ",".join([sub, *map(str, struct.unpack_from(f"<{n}{NUMBER[sub]}", data, p + 5))])
            p += 5 + n * struct.calcsize(NUMBER[sub])
        tags.append(f"{tag}:{kind}:{value}")
    return {
        "qname": name,
        "flag": flag,
        "chr": refs[ref] if ref >= 0 else "*",
        "pos": pos + 1,
        "mapq": mapq,
        "cigar": "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*",
        "mchr": refs[mref] if mref >= 0 else "*",
        "mpos": mpos + 1,
        "isize": isize,
        "seq": seq or "*",
        "qual": "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode(),
        "tags": "\t".join(tags),
    }


def records(source, start: int, end: int, size: int) -> Iterator[dict]:
    """Records that begin in the blocks of a byte range."""
    refs, skip = read_header(source)
    at, data, owned = 0, b"", 0
    place = 0 if start == 0 else first_block(source, start, size)
    if place >= end:
        return
    synced = start == 0
    for where, part in blocks(source, place):
        mine = where < end
        if not mine and at >= owned:
            return
        data = data[at:] + part
        owned = owned - at + (len(part) if mine else 0) if mine else owned - at
        at = 0
        if start == 0 and skip:
            at = min(skip, len(data))
            skip -= at
            if skip:
                continue
        if not synced:
            if len(data) < 1 << 16 and mine and len(part):
                pass
            at = next((i for i in range(len(data)) if plausible(data, i, len(refs))), len(data))
            synced = at < len(data)
        while at < owned and at + 4 <= len(data):
            n = struct.unpack_from("<i", data, at)[0]
            if at + 4 + n > len(data):
                break
            yield decode(data, at, refs)
            at += 4 + n


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in SCHEMA.split(", ")])


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", 64 << 20))

    def _open(self, path: str):
        return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)

    def partitions(self):
        fs, where = self._open(self.path)
        size = fs.get_file_info(where).size
        return [Range(self.path, a, min(a + self.split, size), size) for a in range(0, size, self.split)]

    def read(self, partition):
        fs, where = self._open(partition.path)
        with fs.open_input_file(where) as source:
            rows = []
            for r in records(source, partition.start, partition.end, partition.size):
                rows.append(r)
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
