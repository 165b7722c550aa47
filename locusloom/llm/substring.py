"""Substring dedup by recompression: remove words of long passages that an earlier document also has.

Words are runs of anything but ASCII white space, unchanged. A window is ``LENGTH`` (13) consecutive words of one
document; a word goes if a window that covers it also starts in a document with a smaller doc_id (windows are judged
on the input). The result is exact: sketches only propose, and no window escapes.

**Recompression.** A document is a row of symbols, at first 64-bit names of its words. A round names maximal runs
``a a ... a`` by (a, length), then pairs ``l r`` of neighbours by (l, r), where ``l`` is of the left half of the
alphabet and ``r`` of the right half; a run's half depends on its symbol only. Names and halves are fixed functions
(128-bit mixing, cut to 64 bits) of what they name, the same in every task and document, so equal passages get equal
symbols except near their ends, where a neighbour may pull a symbol over the border. Round ``k`` of ``ROUNDS`` leaves
longer symbols and fewer borders between them.

**Anchors.** A border between two symbols of the last round, with the names of the two, is an anchor. Which words
decide it (those of both symbols, and those that decide *their* borders) is tracked through the rounds as a reach to
the left and to the right; an anchor belongs to a window if its whole reach lies inside, so equal windows have
the same anchors at the same places. Each window picks the anchor with the smallest hashed name among its own; only
picked anchors matter (about one for each five words). A window without an anchor, as in very regular text, is
*bare*.

**Spark rounds.** (1) Name all documents and count picked anchors. An anchor that occurs once proves its windows
unique. (2) An anchor's *context* is all words of the windows it belongs to. Where an earlier document has the same
anchor in the same context, all its windows are known to repeat, by one comparison of 96-bit names, as wide as
those of windows; inside long copies nothing else is left. The first document with a context keeps it open, and if an anchor has several open contexts
(the ends of repeats) their windows are judged one by one: if an earlier document holds a window, then the earliest
that does has it in an open context of the same anchor. (3) Those windows, and all bare ones, are named by 96 bits over
their 13 words, and the smallest doc_id of each name is found. (4) Windows known to repeat are cut out. Names are
pre-aggregated before each shuffle, so a passage that a third of all documents share costs no more than one that two
share.

Edge cases: null and empty texts have no words; kept words of a text without any are the empty string; documents under
13 words lose nothing; rows with the same doc_id are one document for "smaller", each has its own result; a null doc_id
is smaller than any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, M3, Names, bounded, discard, materialise, mix64, release, row_ids

LENGTH = 13
ROUNDS = 2
SLICES = 4  # of the anchors, where all of them are shuffled


def word_names(texts: list[str | None], names: Names) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts, one after another, and how many each text has."""
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]  # bytes split at the six ASCII spaces
    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter(map(names.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum())), n


def recompress(name: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds: first word, name, and reach [lo, hi) of each.

    ``name`` and ``doc`` (the document's number) are by word. The reach has every word that decides the symbol: where
    the same words stand in another text, the same symbol stands there too, whatever surrounds them. A symbol that the
    start or the end of its document helped to decide has reach -1, 0.
    """
    start = np.arange(name.size)
    lo, hi = start.copy(), start + 1
    for level in range(rounds):
        if start.size < 2:
            break
        # runs: a run is decided by its symbols and both neighbours, which are not of it
        inner = doc[start[1:]] == doc[start[:-1]]
        at = np.flatnonzero(np.append(True, ~(inner & (name[1:] == name[:-1]))))
        size = np.diff(np.append(at, start.size))
        lo, hi = _hull(np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), lo, hi, at - 1, np.append(at[1:], start.size), doc, start, at)
        base = name[at]
        name = np.where(size > 1, mix64(base ^ mix64(size.astype(np.uint64) + M3)), base)
        start = start[at]
        n = start.size
        if n < 2:
            break
        # pairs: (left, right) decides itself; a lone left is decided with the symbol after it, a lone right with the one before
        inner = doc[start[1:]] == doc[start[:-1]]
        right = ((mix64(name + np.uint64(level + 1)) >> np.uint64(17)) & np.uint64(1)).astype(bool)
        pair = inner & ~right[:-1] & right[1:]
        at = np.flatnonzero(np.append(True, ~pair))
        size = np.diff(np.append(at, n))
        two, lone_left = size == 2, (size == 1) & ~right[at]
        lone_right = (size == 1) & right[at]
        nobody = np.full(at.size, -2)
        new_lo, new_hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        lo, hi = _hull(new_lo, new_hi, lo, hi, np.where(lone_right, at - 1, nobody), np.where(lone_left, at + 1, nobody), doc, start, at)
        other = name[np.minimum(at + 1, n - 1)]
        name = np.where(two, mix64(mix64(name[at] + M3) ^ (other * M2 + np.uint64(level))), name[at])
        start = start[at]
    return start, name, lo, hi


def _hull(lo, hi, all_lo, all_hi, before, after, doc, start, at):
    """Widen reaches by those of the symbols ``before`` and ``after`` (-2: not needed); beyond the document nothing is sure."""
    n = start.size
    own = doc[start[at]]
    bad = lo < 0
    for other in (before, after):
        need = other != -2
        there = need & (other >= 0) & (other < n)
        o = np.clip(other, 0, n - 1)
        there &= doc[start[o]] == own
        bad |= need & (~there | (all_lo[o] < 0))
        lo, hi = np.where(there, np.minimum(lo, all_lo[o]), lo), np.where(there, np.maximum(hi, all_hi[o]), hi)
    return np.where(bad, -1, lo), np.where(bad, 0, hi)


def anchors(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, key) of the symbols whose reach fits into a window; the key names the symbol in its reach."""
    start, symbol, lo, hi = recompress(name, doc)
    ok = (lo >= 0) & (hi - lo <= LENGTH)
    lo, hi, symbol, start = lo[ok], hi[ok], symbol[ok], start[ok]
    key = mix64(symbol ^ mix64((start - lo).astype(np.uint64) + M1))
    for k in range(LENGTH):
        on = lo + k < hi
        key[on] = mix64(key[on] ^ name[lo[on] + k])
    return lo, hi, key


def picked(lo: np.ndarray, hi: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors some window picks, and (over all words) which windows are bare; windows are numbered by first word.

    An anchor belongs to the windows that begin in [hi - LENGTH, lo].
    """
    total = int(n.sum())
    offset = np.repeat(np.cumsum(n) - n, n)
    window = np.arange(total) - offset + LENGTH <= np.repeat(n, n)
    best = np.full(total, np.iinfo(np.uint64).max, np.uint64)
    first = hi - LENGTH  # may lie before the document, where no window begins
    length = lo - first + 1
    rank = mix64(key + M2)
    places = []
    for k in range(LENGTH):
        on = np.flatnonzero((length > k) & (first + k >= 0))
        w = first[on] + k
        good = window[w] & (offset[w] == offset[lo[on]])
        on, w = on[good], w[good]
        if on.size:
            np.minimum.at(best, w, rank[on])
        places.append((on, w))
    chosen = np.zeros(lo.size, bool)
    for on, w in places:
        chosen[on[best[w] == rank[on]]] = True
    return chosen, window & (best == np.iinfo(np.uint64).max)


def contexts(name, lo, hi, base, n, doc) -> tuple[np.ndarray, np.ndarray]:
    """96 bits over all words of the windows that an anchor belongs to, and over where the document ends among them."""
    one, two = np.zeros(lo.size, np.uint64), np.zeros(lo.size, np.uint64)
    begin, end = (base[lo], base[lo] + n[doc[lo]]) if lo.size else (lo, lo)
    for k in range(2 * LENGTH):
        at = hi - LENGTH + k
        inside = (at >= begin) & (at < end)
        word = np.where(inside, name[np.clip(at, 0, max(name.size - 1, 0))], M1) if lo.size else one
        on = at < lo + LENGTH
        one = np.where(on, mix64(one * M3 + word + np.uint64(k)), one)
        more = (two ^ word) * M1 + np.uint64(k + 1)
        two = np.where(on, more ^ (more >> np.uint64(29)), two)
    return one.view(np.int64), (mix64(two) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def window_names(name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits over the LENGTH words that begin at each place."""
    one, two = np.zeros(at.size, np.uint64), np.zeros(at.size, np.uint64)
    for k in range(LENGTH):
        w = name[at + k]
        one = (one ^ w) * M1 + np.uint64(k + 1)
        one ^= one >> np.uint64(29)
        two = (two + w) * M3
        two ^= two >> np.uint64(32)
    return mix64(one).view(np.int64), mix64(two + M1).view(np.int64)


def _ranges(flags: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of true flags inside a document."""
    at = np.flatnonzero(flags)
    if not at.size:
        return at, at
    new = np.append(True, (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]]))
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, at.size))


def find_anchors(rows: DataFrame) -> DataFrame:
    """Picked anchors and bare windows of each row: key (null: bare), 96-bit name of the context (c1, c2), rid, and the place: first window << 32 | windows."""

    def run(batches):
        names = Names()
        for batch in bounded(batches, "text"):
            name, n = word_names(batch.column("text").to_pylist(), names)
            doc = np.repeat(np.arange(n.size), n)
            base = np.repeat(np.cumsum(n) - n, n)
            lo, hi, key = anchors(name, doc)
            chosen, bare = picked(lo, hi, key, n)
            lo, hi, key = lo[chosen], hi[chosen], key[chosen]
            c1, c2 = contexts(name, lo, hi, base, n, doc)
            first = np.maximum(hi - LENGTH, base[lo]) if lo.size else lo
            last = np.minimum(lo, base[lo] + n[doc[lo]] - LENGTH) if lo.size else lo
            at, length = _ranges(bare, doc)
            rid = batch.column("rid").to_numpy()
            owner = doc[np.concatenate((lo, at))]
            begin, size = np.concatenate((first, at)), np.concatenate((last - first + 1, length))
            place = (begin - base[begin] if begin.size else begin) << 32 | size
            keys = pa.array(np.concatenate((key.view(np.int64), np.zeros(at.size, np.int64))), mask=np.arange(begin.size) >= lo.size)
            c1, c2 = (np.concatenate((c, np.zeros(at.size, c.dtype))) for c in (c1, c2))
            yield pa.RecordBatch.from_arrays([keys, pa.array(c1), pa.array(c2), pa.array(rid[owner]), pa.array(place)], ["key", "c1", "c2", "rid", "place"])

    return rows.select("rid", "text").mapInArrow(run, "key long, c1 long, c2 int, rid long, place long")


def name_windows(rows: DataFrame) -> DataFrame:
    """One row for each window in the ``places`` of a row: its 96-bit name (w1, w2), rid and first word."""

    def run(batches):
        names = Names()
        for batch in bounded(batches, "text", 1 << 21):
            name, n = word_names(batch.column("text").to_pylist(), names)
            base = np.cumsum(n) - n
            lists = batch.column("places")
            place = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(n.size), lists.value_lengths().to_numpy())
            flag = np.zeros(name.size + 1, np.int32)
            first = base[owner] + (place >> 32)
            np.add.at(flag, first, 1)
            np.add.at(flag, first + (place & 0xFFFFFFFF), -1)
            at = np.flatnonzero(np.cumsum(flag[:-1]))
            w1, w2 = window_names(name, at)
            doc = np.repeat(np.arange(n.size), n)[at]
            rid = batch.column("rid").to_numpy()[doc]
            pos = (at - base[doc]).astype(np.int32)
            for a in range(0, at.size, 1 << 18):
                b = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(w1[b]), pa.array(w2[b].astype(np.int32)), pa.array(rid[b]), pa.array(pos[b])], ["w1", "w2", "rid", "pos"])

    return rows.select("rid", "text", "places").mapInArrow(run, "w1 long, w2 int, rid long, pos int")


def cut(words: list[bytes], windows: np.ndarray | None) -> tuple[int, list[bytes]]:
    """How many words the windows of these places (first window << 32 | windows) cover, and the words left."""
    if windows is None or not len(windows):
        return 0, words
    flag = np.zeros(len(words) + 1, np.int32)
    first = windows >> 32
    np.add.at(flag, first, 1)
    np.add.at(flag, first + (windows & 0xFFFFFFFF) + (LENGTH - 1), -1)
    gone = np.cumsum(flag[:-1]) > 0
    return int(gone.sum()), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, doc_id, text), and (rid, windows): the places of windows that an earlier document has too."""
    rows, unique = row_ids(docs, "substring-rows")
    found = materialise(find_anchors(rows), "substring-anchors")
    shared = materialise(found.where("key is not null").groupBy("key").count().where("count > 1").select("key"), "substring-shared")
    release(docs.sparkSession)
    parts, known = [], None
    for k in range(SLICES):  # of the keys, one after another, so that only one slice's shuffle is on disk
        part = materialise(found.where(F.pmod("key", F.lit(SLICES)) == k).join(shared, "key", "left_semi"), "substring-known")
        parts.append(part)
        release(docs.sparkSession)
        known = part if known is None else known.unionByName(part)
    bare = materialise(found.where("key is null").select("rid", "place"), "substring-bare")
    discard(found)
    discard(shared)

    order = rows.select("rid", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"))
    with_order = lambda df: df.withColumn("d", F.col("rid")) if unique else df.join(order, "rid")
    first = with_order(known).groupBy("key", "c1", "c2").agg(F.min("d").alias("low"))
    first = materialise(first, "substring-contexts")
    several = first.groupBy("key").agg(F.count("*").alias("open")).where("open > 1").select("key")
    judged = with_order(known).join(first, ["key", "c1", "c2"])
    repeats = materialise(judged.where("low < d").select("rid", "place"), "substring-repeats")
    unsure = judged.where("low = d").select("key", "rid", "place").join(several, "key", "left_semi").select("rid", "place")
    places = materialise(unsure.unionByName(bare).groupBy("rid").agg(F.collect_set("place").alias("places")), "substring-places")
    for df in (*parts, bare, first):
        discard(df)

    windows = materialise(name_windows(rows.join(places, "rid")), "substring-windows")
    discard(places)
    ordered = with_order(windows)
    mins = materialise(ordered.groupBy("w1", "w2").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low < high").select("w1", "w2", "low"), "substring-mins")
    single = ordered.join(mins, ["w1", "w2"]).where("low < d").select("rid", (F.col("pos").cast("long") * (1 << 32) + 1).alias("place"))
    gone = materialise(single.unionByName(repeats).groupBy("rid").agg(F.collect_set("place").alias("windows")), "substring-gone")
    for df in (windows, mins, repeats):
        discard(df)
    return rows, gone


def dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; with ``texts`` also kept_text, the kept words joined by spaces."""
    rows, gone = repeated_windows(docs)

    def run(batches):
        for batch in bounded(batches, "text"):
            out = []
            for text, windows in zip(batch.column("text").to_pylist(), batch.column("windows"), strict=True):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                removed, kept = cut(words, windows.values.to_numpy(zero_copy_only=False) if windows.is_valid else None)
                joined = b" ".join(kept)
                out.append((len(words), removed, hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if texts else None))
            n, r, h, t = zip(*out, strict=True) if out else ((),) * 4
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(h, pa.string()), pa.array(t, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays[: 4 + texts], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + texts])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return rows.join(gone, "rid", "left").select("doc_id", "text", "windows").mapInArrow(run, schema)
