"""Token-ID files: documents encoded by a public tokenizer, stored as patched frame-of-reference blocks.

A file holds the ids of consecutive documents (ascending doc_id, each closed by an end id) as one stream, cut into
blocks of ``BLOCK`` ids. A block stores its smallest id, and each id less that minimum in as many bits as the
``PERCENTILE`` largest of them needs; what does not fit keeps its low bits there, and its position and high bits stand
in the block's exception list. Layout, little-endian::

    b"PFOR1\\0"                                           magic
    blocks, each: u32 minimum, u8 width, u16 ids, u16 exceptions, u16 positions[], u32 high bits[], packed low bits
    u64 block starts[blocks]
    i64 doc_id[docs], u8 doc_id is null[docs], u32 ids[docs]
    u64 place of the block starts, u64 blocks, u64 docs, u64 ids, b"PFOR1\\0"

so that a reader finds any document's blocks from the index alone.

Writing: documents are dealt to contiguous ranges of doc_id, each range is sorted and streamed into one file in the
shared folder under a name of its own; only names that finished tasks return enter the manifest, so a lost or
repeated task leaves no trace. The manifest (one short row for each file) gives each file's first position.

Edge cases: null and empty texts are the end id alone; equal or null doc_ids each keep their row, null first, ties by
text; an empty table writes nothing and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, filesystem, parts_of, range_parts, work_path

BLOCK, PERCENTILE = 1024, 0.95
MAGIC = b"PFOR1\0"
HEAD, HEAD_SIZE = "<IBHH", 9
TAIL, TAIL_SIZE = "<QQQQ6s", 38
ASCII_SPACE = re.compile("[ \\t\\n\\r\\x0b\\x0c]+")


#: What Python's ``str.split`` cuts at.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Those that Unicode doesn't count as white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Beginnings and ends of tokens on which a tokenizer is probed.
PROBES = ["a", "Word", "É", "e\u0301", "\u0301", "1", "12", "it's", "'s", "'", "''re", "ß", "ΑΣ", "Σ", "İ", "ﬁ", "漢字", "\u0e33", "\u200d", "ก", "<", "<|", "|>", "<|endoftext|>", "!!", "-", "\ufeff", "\U0001f600", "\ud7a3", "x" * 40]


def parts_at_space(tokenizer) -> bool:
    """Whether a text's ids are those of its white-space tokens in turn, so that each token needs encoding but once.

    Proven from the tokenizer's own definition: its normaliser works character by character but for composition, which
    never joins white space; only what a pattern matches is kept, and no match holds white space; nothing is added
    before or after a text; added tokens hold no white space. It is then probed with each white-space character
    between all kinds of neighbours. A tokenizer that fails either is always given whole texts.
    """
    got = json.loads(tokenizer.to_str())
    steps = (got.get("normalizer") or {}).get("normalizers", [])
    local = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps)
    cuts = (got.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kept = len(cuts) == 2 and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    if not (steps and local and kept and not got.get("post_processor")) or any(set(x["content"]) & set(SPACES) or x["lstrip"] or x["rstrip"] for x in got["added_tokens"]):
        return False
    ids = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    alone = ids(PROBES)
    pairs = [(i, (i * 7 + k) % len(PROBES)) for i in range(len(PROBES)) for k in range(5)]
    return all(ids([PROBES[i] + c + PROBES[j] for i, j in pairs]) == [alone[i] + alone[j] for i, j in pairs] for c in SPACES if c not in SEPARATORS)


#: The pattern whose matches are pre-tokens, fixed by the tokenizer file; and the same over PLAIN text, lower-cased, with the space between two tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_PARTS = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+").findall
#: ASCII and the letters of Latin-1: lower-casing maps these one to one, and composition leaves them alone.
PLAIN = re.compile(r"[ -~À-ÖØ-öø-ÿ]*").fullmatch


def parts_at_pattern(tokenizer) -> bool:
    """Whether the ids of a plain token are those of its pre-tokens in turn: the pattern is the known one, the tokenizer
    lower-cases, its model marks the end of a pre-token, added tokens are not plain words, and probes agree."""
    got = json.loads(tokenizer.to_str())
    if got["model"].get("end_of_word_suffix") != "</w>":
        return False
    cut = (got.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
    if cut != PATTERN or "Lowercase" not in [x["type"] for x in got["normalizer"]["normalizers"]] or any(not x["content"].startswith("<|") for x in got["added_tokens"]):
        return False
    ids = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    some = ["a", "Ab", "É", "ß", "ÿ", "'", "'s", "'RE", "7", "-", "--", "<", "|", "_", "$"]
    probes = [x + y + z for x in some for y in some for z in some if "<|" not in x + y + z]
    return ids(probes) == [[i for part in ids(PLAIN_PARTS(x.lower())) for i in part] for x in probes]


class _Numbers(dict):
    """Token -> its number; unseen ones are numbered and noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.taken = 0

    def __missing__(self, token: str) -> int:
        self.new.append(token)
        self[token] = n = len(self)
        return n

    def fresh(self) -> list[str]:
        """The tokens numbered since the last call."""
        new, self.new = self.new, []
        self.taken += sum(map(len, new)) + 150 * len(new)  # bytes, with the entries and ids
        return new


class _Ids:
    """Runs of ids by number."""

    def __init__(self):
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.known = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + ids.size > self.flat.size:
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.known + sizes.size > self.starts.size:
            self.starts, self.sizes = (np.concatenate((x, np.empty_like(x))) for x in (self.starts, self.sizes))
        own = slice(self.known, self.known + sizes.size)
        self.flat[self.used : self.used + ids.size] = ids
        self.starts[own] = self.used + np.cumsum(sizes) - sizes
        self.sizes[own] = sizes
        self.used, self.known = self.used + ids.size, self.known + sizes.size

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbers, one run after another, and the runs' sizes."""
        size = self.sizes[which]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.starts[which] - end + size, size) + np.arange(end[-1] if end.size else 0)], size


def split(text: str | None) -> list[str]:
    """White-space tokens. Python also splits at ``SEPARATORS``, which tokenizers keep; those texts are cut at ASCII white space."""
    if not text:
        return []
    return ASCII_SPACE.split(text) if any(c in text for c in SEPARATORS) else text.split()


class Encoder:
    """Encodes whole texts with a tokenizer file and its library. What the library has once encoded is remembered (``most``
    bytes at most): pre-tokens of plain words where :func:`parts_at_pattern` holds, white-space tokens where
    :func:`parts_at_space` does; for any other tokenizer the library gets each text whole."""

    def __init__(self, path: str, most: int = 96 << 20):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.by_token = parts_at_space(self.tokenizer)
        self.by_part = self.by_token and parts_at_pattern(self.tokenizer)
        if self.by_part:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.number, self.ids = _Numbers(), _Ids()
        self.part, self.part_ids = _Numbers(), _Ids()
        self.part[" "] = 0
        self.part_ids.add(np.empty(0, np.uint32), np.zeros(1, np.int64))

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each has."""
        ids, sizes = [], np.empty(len(texts), np.int64)
        for a in range(0, len(texts), 4096):
            own = [e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + 4096], add_special_tokens=False)]
            sizes[a : a + len(own)] = list(map(len, own))
            ids.append(np.fromiter(chain.from_iterable(own), np.uint32, int(sizes[a : a + len(own)].sum())))
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), sizes

    def _pre_tokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_library`, of pre-tokens: many in one text; the vocabulary marks the ids that end one."""
        texts = [" ".join(parts[a : a + 2048]) for a in range(0, len(parts), 2048)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[ids])
        if last.size != len(parts) or last[-1] != ids.size - 1:
            raise ValueError("a pre-token came apart")
        return ids, np.diff(last, prepend=-1)

    def _tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_library`, of white-space tokens; plain ones are cut into pre-tokens, each of which the library is asked for once."""
        plain = np.zeros(len(tokens), bool)
        for a in range(0, len(tokens) if self.by_part else 0, 256):
            some = " ".join(tokens[a : a + 256])
            plain[a : a + 256] = True if PLAIN(some) and "<|" not in some else [bool(PLAIN(t)) and "<|" not in t for t in tokens[a : a + 256]]
        if not plain.any():
            return self._library(tokens)
        which = np.fromiter(map(self.part.__getitem__, PLAIN_PARTS(" ".join([t for t, p in zip(tokens, plain.tolist(), strict=True) if p]).lower())), np.int64)
        if self.part.new:
            self.part_ids.add(*self._pre_tokens(self.part.fresh()))
        got, size = self.part_ids.gather(which)
        if plain.all():
            return got, np.bincount(np.cumsum(which == 0), size, minlength=len(tokens)).astype(np.int64)
        sizes = np.empty(len(tokens), np.int64)
        sizes[plain] = np.bincount(np.cumsum(which == 0), size, minlength=int(plain.sum())).astype(np.int64)
        odd, sizes[~plain] = self._library([t for t, p in zip(tokens, plain.tolist(), strict=True) if not p])
        out, of_plain = np.empty(int(sizes.sum()), np.uint32), np.repeat(plain, sizes)
        out[of_plain], out[~of_plain] = got, odd
        return out, sizes

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has (with its end id)."""
        if not self.by_token:
            got, n = self._library([t or "" for t in texts])
            own = n + 1
        else:
            if self.number.taken + self.part.taken > self.most:
                self._forget()
            tokens = [split(t) for t in texts]
            n = np.fromiter(map(len, tokens), np.int64, len(tokens))
            which = np.fromiter(map(self.number.__getitem__, chain.from_iterable(tokens)), np.int64, int(n.sum()))
            if self.number.new:
                self.ids.add(*self._tokens(self.number.fresh()))
            got, size = self.ids.gather(which)
            total, at = np.concatenate(([0], np.cumsum(size))), np.concatenate(([0], np.cumsum(n)))
            own = total[at[1:]] - total[at[:-1]] + 1
        out = np.full(int(own.sum()), end, np.uint32)
        out[np.arange(got.size) + np.repeat(np.arange(len(texts)), own - 1)] = got  # each earlier text has one end id
        return out, own


def pack(ids: np.ndarray) -> Iterator[bytes]:
    """The blocks of a run of ids, in order; all but the last are full."""
    for a in range(0, ids.size, BLOCK * 256):
        part = ids[a : a + BLOCK * 256]
        n = -(-part.size // BLOCK)
        grid = np.resize(part, n * BLOCK) if part.size % BLOCK else part
        grid = grid.reshape(n, BLOCK).astype(np.uint32)
        sizes = np.full(n, BLOCK)
        if part.size % BLOCK:
            sizes[-1] = part.size % BLOCK
            grid[-1, sizes[-1] :] = grid[-1, 0]
        low = grid.min(axis=1)
        grid = grid - low[:, None]
        k = int(PERCENTILE * BLOCK)
        at = np.partition(grid, k, axis=1)[:, k]
        if sizes[-1] < BLOCK:
            own = np.sort(grid[-1, : sizes[-1]])
            at[-1] = own[min(own.size - 1, int(PERCENTILE * own.size))]
        width = np.array([int(x).bit_length() for x in at])
        packed: list[bytes] = [b""] * n
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                bits = np.empty((rows.size, BLOCK, w), np.uint8)
                for b in range(w):
                    bits[:, :, b] = (grid[rows] >> np.uint32(b)) & np.uint32(1)
                lows = np.packbits(bits.reshape(rows.size, -1), axis=1, bitorder="little")
            high = grid[rows].astype(np.uint64) >> np.uint64(w)
            for j, i in enumerate(rows):
                over = np.flatnonzero(high[j, : sizes[i]])
                body = lows[j, : -(-int(sizes[i]) * int(w) // 8)].tobytes() if w else b""
                packed[i] = struct.pack(HEAD, low[i], w, sizes[i], over.size) + over.astype("<u2").tobytes() + high[j, over].astype("<u4").tobytes() + body
        yield from packed


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; ``starts`` has their places in ``data``."""
    heads = [struct.unpack_from(HEAD, data, s) for s in starts]
    out = np.empty(sum(h[2] for h in heads), np.uint32)
    first = np.concatenate(([0], np.cumsum([h[2] for h in heads]))).astype(np.int64)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (_, w, n, _) in enumerate(heads):
        groups.setdefault((w, n), []).append(i)
    for (w, n), rows in groups.items():
        size = -(-n * w // 8)
        if w:
            raw = np.stack([np.frombuffer(data, np.uint8, size, int(starts[i]) + HEAD_SIZE + 6 * heads[i][3]) for i in rows])
            bits = np.unpackbits(raw, axis=1, count=n * w, bitorder="little").reshape(len(rows), n, w)
            values = np.zeros((len(rows), n), np.uint32)
            for b in range(w):
                values |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
        else:
            values = np.zeros((len(rows), n), np.uint32)
        for j, i in enumerate(rows):
            minimum, _, _, over = heads[i]
            at = int(starts[i]) + HEAD_SIZE
            if over:
                where = np.frombuffer(data, "<u2", over, at)
                values[j, where] |= (np.frombuffer(data, "<u4", over, at + 2 * over).astype(np.uint64) << np.uint64(w)).astype(np.uint32)
            out[first[i] : first[i + 1]] = values[j] + np.uint32(minimum)
    return out


class Writer:
    """Streams documents into one file."""

    def __init__(self, sink):
        self.sink, self.at, self.starts, self.rest, self.ids = sink, len(MAGIC), [], np.empty(0, np.uint32), 0
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sink.write(MAGIC)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs.append((doc_ids.astype("<i8"), nulls.astype("u1"), sizes.astype("<u4")))
        self.ids += ids.size
        ids = np.concatenate((self.rest, ids))
        whole = ids.size - ids.size % BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        for b in pack(ids):
            self.starts.append(self.at)
            self.at += len(b)
            self.sink.write(b)

    def close(self) -> tuple[int, int]:
        self._blocks(self.rest)
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        n = sum(d[0].size for d in self.docs)
        for k in range(3):
            for d in self.docs:
                self.sink.write(d[k].tobytes())
        self.sink.write(struct.pack(TAIL, self.at, len(self.starts), n, self.ids, MAGIC))
        return n, self.ids


class Reader:
    """Reads a file's documents in order, or any run of them."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - TAIL_SIZE)
        index, blocks, self.n_docs, self.n_ids, magic = struct.unpack(TAIL, source.read(TAIL_SIZE))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(index)
        tail = source.read(size - TAIL_SIZE - index)
        self.starts = np.append(np.frombuffer(tail, "<u8", blocks), index).astype(np.int64)
        at = 8 * blocks
        self.doc_ids = np.frombuffer(tail, "<i8", self.n_docs, at)
        self.nulls = np.frombuffer(tail, "u1", self.n_docs, at + 8 * self.n_docs)
        self.sizes = np.frombuffer(tail, "<u4", self.n_docs, at + 9 * self.n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the stream; decodes only the blocks that hold them."""
        if b <= a:
            return np.empty(0, np.uint32)
        lo, hi = a // BLOCK, -(-b // BLOCK)
        self.source.seek(int(self.starts[lo]))
        data = self.source.read(int(self.starts[hi] - self.starts[lo]))
        return unpack(data, self.starts[lo:hi] - self.starts[lo])[a - lo * BLOCK : b - lo * BLOCK]

    def documents(self, step: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
        """(number in the file, its ids), decoding about ``step`` ids at a time."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.first, self.first[i] + step, side="right")) - 1)
            run = self.ids(int(self.first[i]), int(self.first[j]))
            for k in range(i, j):
                yield k, run[self.first[k] - self.first[i] : self.first[k + 1] - self.first[i]]
            i = j


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, files: int | None = None) -> list[dict]:
    """Encode ``docs`` (doc_id, text) into files under ``path``; returns the manifest in order: path, docs, ids, start (ids before it)."""
    n = files or parts_of(docs.sparkSession)
    rows = range_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), "doc_id", n, "part")

    def store(batches):
        fs, folder = filesystem(path)
        encoder = writer = sink = name = None
        part = -1

        def close():
            n_docs, n_ids = writer.close()
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{path}/{name}"]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["part", "path", "docs", "ids"])

        for batch in bounded(batches, "text"):
            encoder = encoder or Encoder(tokenizer)
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if parts[a] != part:
                    if writer:
                        yield close()
                    part, name = int(parts[a]), f"part-{int(parts[a]):06d}-{uuid.uuid4().hex}.pfor"
                    sink = fs.open_output_stream(f"{folder}/{name}")
                    writer = Writer(sink)
                own = batch.slice(a, b - a)
                ids, sizes = encoder.encode(own.column("text").to_pylist(), end)
                key = own.column("doc_id")
                writer.add(key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False), ids, sizes)
        if writer:
            yield close()

    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    sorted_rows = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "text")
    manifest = [r.asDict() for r in sorted_rows.mapInArrow(store, "part int, path string, docs long, ids long").collect()]
    start = 0
    for m in sorted(manifest, key=lambda m: m["part"]):
        m["start"] = start
        start += m["ids"]
    return sorted(manifest, key=lambda m: m["part"])


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files; one task for each file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(i, m["path"], m["start"]) for i, m in enumerate(manifest)], "i int, path string, start long")

    def load(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, where = filesystem(path)
                with fs.open_input_file(where) as source:
                    reader = Reader(source)
                    crc = np.fromiter((zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()) for _, ids in reader.documents()), np.int64, reader.n_docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, pa.int64(), mask=reader.nulls.astype(bool)), pa.array(start + reader.first[:-1], pa.int64()), pa.array(reader.sizes.astype(np.int64), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return files.repartitionById(len(manifest), F.col("i")).mapInArrow(load, schema)


def encode(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and return what is read back from them."""
    spark = docs.sparkSession
    return read(spark, write(docs, work_path(spark, "tokens"), tokenizer, end))
