"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into pieces: at line ends, after sentence ends, and inside long sentences before words whose hash says
so (about every eighth), so that an edit changes the pieces around it and no others. A piece's digest is 64 bits of
xxHash of its words; the k-th piece with the same digest gets an occurrence number, so a text is a set of keys.

A sketch of ``m`` cells adds each key to three cells (one in each third): a count, the sum of keys and the sum of key
checks, all modulo powers of two. The difference of two sketches, cell by cell, holds just the keys in which the
texts differ; peeling takes keys out of cells with count +1 or -1 whose check fits until nothing is left. If it gets
stuck, both sketches are built again with twice the cells. The likeness of two texts is the share of keys in common:
(n + n' - d) / (n + n' + d) with d the number of keys peeled, 1 for two texts without pieces.

The stored fingerprint is the sketch of ``CELLS`` cells in base64 after the number of keys; equal texts have equal
fingerprints, and the fingerprints of two versions alone tell their difference as long as it fits.

Each document is also sketched next to the one that follows it (ascending doc_id, null first, ties by text; after the
last comes the first). Documents are dealt to contiguous ranges and streamed in order; the first row of a range is
also sent to the range before it, so no task needs another's rows and each text moves once.

Edge cases: null and empty texts have no pieces; a single document follows itself; repeated rows each have a result;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import M3, bounded, mix64, parts_of, range_parts

CELLS = 24
PIECE = re.compile(r"[^\n.!?]+[\n.!?]*|[\n.!?]+")


class Words(dict):
    """Word -> whether a piece begins at it, inside a long sentence; forgets all once its words take ``most`` bytes."""

    def __init__(self, most: int = 32 << 20):
        super().__init__()
        self.most, self.taken = most, 0

    def __missing__(self, word: str) -> bool:
        self.taken += len(word) + 120
        if self.taken > self.most:
            self.clear()
            self.taken = len(word) + 120
        self[word] = out = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % 8 == 0
        return out


_cuts = Words()


def pieces(text: str | None, long: int = 12) -> list[str]:
    out: list[str] = []
    for sentence in PIECE.findall(text) if text else ():
        w = sentence.split()
        if not w:
            continue
        if len(w) <= long:
            out.append(" ".join(w))
            continue
        start = 0
        for i in [i for i, c in enumerate(map(_cuts.__getitem__, w)) if c]:
            if i - start >= 4:
                out.append(" ".join(w[start:i]))
                start = i
        out.append(" ".join(w[start:]))
    return out


def keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each text one after another, and how many each has."""
    parts = [pieces(t) for t in texts]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    h = np.fromiter((xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for own in parts for p in own), np.uint64, int(n.sum()))
    owner = np.repeat(np.arange(len(parts)), n)
    order = np.lexsort((h, owner))
    same = np.append(False, (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1]))[: h.size]
    if same.any():
        at = np.arange(h.size)
        run = at - np.maximum.accumulate(np.where(same, 0, at))
        h[order] = h[order] ^ mix64(run.astype(np.uint64))
    return h, n


def checks(key: np.ndarray) -> np.ndarray:
    return (mix64(key ^ M3) >> np.uint64(32)).astype(np.uint32)


def cells_of(key: np.ndarray, m: int) -> np.ndarray:
    """(3, keys) cells: one in each third of m."""
    third = np.uint64(m // 3)
    h = mix64(key + np.uint64(m))
    out = np.empty((3, key.size), np.int64)
    for j in range(3):
        out[j] = ((h >> np.uint64(21 * j)) & np.uint64(0x1FFFFF)) * third >> np.uint64(21)
        out[j] += j * (m // 3)
    return out


def build(key: np.ndarray, n: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, key sum and check sum of the m cells of each text: three (texts, m) arrays."""
    size = n.size * m
    at = (cells_of(key, m) + np.repeat(np.arange(n.size) * m, n)).ravel()
    count = np.bincount(at, minlength=size).astype(np.int32)
    sums, proof = np.zeros(size, np.uint64), np.zeros(size, np.uint32)
    np.add.at(sums, at, np.tile(key, 3))
    np.add.at(proof, at, np.tile(checks(key), 3))
    return count.reshape(-1, m), sums.reshape(-1, m), proof.reshape(-1, m)


def peel(count: np.ndarray, sums: np.ndarray, proof: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of keys in each difference (rows), and whether it was peeled to nothing."""
    rows, m = count.shape
    count, sums, proof = count.ravel().copy(), sums.ravel().copy(), proof.ravel().copy()
    found = np.zeros(rows, np.int64)
    at = np.flatnonzero(np.abs(count) == 1)
    while at.size:
        sign = count[at]
        key = np.where(sign == 1, sums[at], ~sums[at] + np.uint64(1))
        want = np.where(sign == 1, proof[at], ~proof[at] + np.uint32(1))
        ok = (np.abs(sign) == 1) & (checks(key) == want)
        at, key, sign = at[ok], key[ok], sign[ok]
        own = cells_of(key, m) + at // m * m
        ok = (own == at).any(axis=0)
        at, key, sign, own = at[ok], key[ok], sign[ok], own[:, ok]
        if not at.size:
            break
        order = np.lexsort((key, at // m))  # a key may show in several of its cells at once
        row, k = (at // m)[order], key[order]
        pick = order[np.append(True, (row[1:] != row[:-1]) | (k[1:] != k[:-1]))]
        key, sign, own, at = key[pick], sign[pick], own[:, pick], at[pick]
        found += np.bincount(at // m, minlength=rows)
        flat, times = own.ravel(), np.tile(sign, 3)
        np.subtract.at(count, flat, times)
        np.subtract.at(sums, flat, np.where(times == 1, np.tile(key, 3), ~np.tile(key, 3) + np.uint64(1)))
        np.subtract.at(proof, flat, np.where(times == 1, np.tile(checks(key), 3), ~np.tile(checks(key), 3) + np.uint32(1)))
        flat = np.unique(flat)
        at = flat[np.abs(count[flat]) == 1]
    left = (count.reshape(rows, m) != 0).any(axis=1) | (sums.reshape(rows, m) != 0).any(axis=1) | (proof.reshape(rows, m) != 0).any(axis=1)
    return found, ~left


def recover(key_a: np.ndarray, key_b: np.ndarray, m: int = CELLS) -> tuple[set[int], set[int], int]:
    """The keys only in a, those only in b, and the cells it took: the plain form of one difference."""
    np.seterr(over="ignore")
    while True:
        one = np.array([key_a.size]), np.array([key_b.size])
        count, sums, proof = (x[0].astype(x.dtype) - y[0] for x, y in zip(build(key_a, one[0], m), build(key_b, one[1], m), strict=True))
        a, b = set(), set()
        again = True
        while again:
            again = False
            for i in np.flatnonzero(np.abs(count) == 1):
                sign = int(count[i])
                key = np.array([sums[i] if sign == 1 else ~sums[i] + np.uint64(1)], np.uint64)
                if abs(sign) == 1 and checks(key)[0] == (proof[i] if sign == 1 else ~proof[i] + np.uint32(1)) and i in (own := cells_of(key, m)[:, 0]):
                    (a if sign == 1 else b).add(int(key[0]))
                    for j in own:
                        count[j] -= sign
                        sums[j] = sums[j] - key[0] if sign == 1 else sums[j] + key[0]
                        proof[j] = proof[j] - checks(key)[0] if sign == 1 else proof[j] + checks(key)[0]
                    again = True
        if not count.any() and not sums.any() and not proof.any():
            return a, b, m
        m *= 2


def likeness(key_a: np.ndarray, n_a: np.ndarray, key_b: np.ndarray, n_b: np.ndarray, first=None) -> tuple[np.ndarray, np.ndarray]:
    """Likeness of each pair of texts, and the cells that peeling took; ``first``: the pair's sketches of CELLS cells."""
    total = n_a + n_b
    diff, took = np.zeros(n_a.size, np.int64), np.full(n_a.size, CELLS)
    todo, m = np.arange(n_a.size), CELLS
    at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    while todo.size:
        step = max(1, (1 << 21) // m)
        failed = []
        for k in range(0, todo.size, step):
            rows = todo[k : k + step]
            if m == CELLS and first is not None:
                (ca, sa, pa_), (cb, sb, pb) = ((x[rows] for x in side) for side in first)
            else:
                (ca, sa, pa_), (cb, sb, pb) = (build(np.concatenate([key[at[r] : at[r] + n[r]] for r in rows]), n[rows], m) for key, n, at in ((key_a, n_a, at_a), (key_b, n_b, at_b)))
            found, done = peel(ca - cb, sa - sb, pa_ - pb)
            diff[rows[done]], took[rows[done]] = found[done], m
            failed.append(rows[~done])
        todo, m = np.concatenate(failed), 2 * m
    return np.where(total > 0, (total - diff) / np.maximum(total + diff, 1), 1.0), took


def as_text(n: np.ndarray, sketch: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[str]:
    count, sums, proof = sketch
    raw = np.concatenate([n.astype("<u4")[:, None].view("u1"), np.ascontiguousarray(sums.astype("<u8")).view("u1"), np.ascontiguousarray(proof.astype("<u4")).view("u1"), np.ascontiguousarray(count.astype("<u4")).view("u1")], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def edit(text: str | None, following: str | None) -> str:
    """The last quarter of the code points replaced by as many first ones (or all) of the following text."""
    text, following = text or "", following or ""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells_edited int, cells_next int"


def compare(doc_ids: list, texts: list[str | None]) -> pa.RecordBatch:
    """The rows of all texts but the last, each against the one after it."""
    edited = [edit(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    key, n = keys(texts)
    sketch = build(key, n, CELLS)
    e_key, e_n = keys(edited)
    e_sketch = build(e_key, e_n, CELLS)
    own = int(n[:-1].sum())
    near_edited, cells_edited = likeness(key[:own], n[:-1], e_key, e_n, (tuple(x[:-1] for x in sketch), e_sketch))
    near_next, cells_next = likeness(key[:own], n[:-1], key[n[0] :], n[1:], (tuple(x[:-1] for x in sketch), tuple(x[1:] for x in sketch)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids[:-1], pa.int64()),
            pa.array([len(t or "") for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array(as_text(n, sketch)[:-1]),
            pa.array(as_text(e_n, e_sketch)),
            pa.array(near_edited),
            pa.array(near_next),
            pa.array(cells_edited, pa.int32()),
            pa.array(cells_next, pa.int32()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "cells_edited", "cells_next"],
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the cells each peeling took."""
    n = parts_of(docs.sparkSession)
    rows = range_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), "doc_id", n, "part")
    # the first id of each range goes to the range before it too; n rows at most, so they may be broadcast
    firsts = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("f"))
    around = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(F.col("part").alias("p"), F.col("f.doc_id").alias("first"), F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(around)).alias("before"))
    rows = rows.join(F.broadcast(firsts), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(F.struct(F.col("part"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(True).alias("guest"))))).alias("to"))
    rows = rows.select("doc_id", "text", "to.part", "to.guest").repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "text")

    def run(batches):
        ids, texts, part, closed = [], [], None, False  # the last document seen waits for the one after it
        for batch in bounded(batches, "text"):
            parts, guests = batch.column("part").to_pylist(), batch.column("guest").to_pylist()
            own_ids, own_texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            i = 0
            while i < len(parts):
                if parts[i] != part:
                    ids, texts, part, closed = [], [], parts[i], False
                j = i
                while j < len(parts) and parts[j] == part and not guests[j]:
                    j += 1
                ids, texts = ids + own_ids[i:j], texts + own_texts[i:j]
                if j < len(parts) and parts[j] == part and not closed:  # the first guest ends the range
                    ids, texts, closed = ids + [own_ids[j]], texts + [own_texts[j]], True
                if len(texts) > 1:
                    yield compare(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]
                while j < len(parts) and parts[j] == part and guests[j]:
                    j += 1
                i = j

    return rows.mapInArrow(run, SCHEMA)
