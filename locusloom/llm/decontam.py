"""Benchmark decontamination: a BM25 index of test items, block-max pruning of every training passage, exact checks.

Texts are lower-cased and cut into ``\\w+`` words. Each test item is a document of the index; a posting's impact is
its BM25 share ``idf * tf * (k1 + 1) / (tf + norm)`` divided by the sum over the item, so a passage that holds every
word of an item scores 1 and one threshold serves all items. Documents are read as passages of two strides, a new one
each stride, where a stride is at least as long as the longest item of the index shard: whatever is copied from an
item lies whole in some passage.

The search is safe (nothing at or above the threshold is missed) and skips by the bounds of block-max WAND. It is its
batch form: bounds are added for many passages at once, with no cursors or pivots for each passage:

* The most frequent words of the index are *non-essential* as long as no item owes them more than ``REST`` of its
  score. Only the other, essential, words open posting lists; an item none of whose essential words occur can't reach
  the threshold.
* Items are numbered in blocks of ``BLOCK``. The postings of a word are first read as one maximum per block; blocks
  whose sum of maxima plus the block's largest non-essential share stays under the threshold are skipped.
* Items of the blocks left are scored exactly.

A hit at or above ``threshold`` is then verified in the passage: at least ``overlap`` of the distinct ``n``-grams of
the item's question, and of its answer, must occur. The answer is the last sentence of the item and the question the
rest; an item of one sentence is cut after three quarters of its words.

Items are read in shards of at most ``shard_bytes`` of text, so what is broadcast has a fixed size; document
frequencies and lengths are those of all items.

Edge cases: null or wordless texts and items match nothing; an item of fewer than ``n`` words must occur as one run;
repeated rows give repeated decisions but one result row for each (doc_id, item_id); rows with a null id are searched
and reported with null; empty tables give empty results; other columns are ignored by :func:`leaks` and kept by
:func:`clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, by_run, received, shipped

K1, B = 1.2, 0.75
BLOCK = 8
REST = 0.3
MIN_STRIDE = 64
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?][\"')\]]*\s+|\n+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    cut = [m.end() for m in SENTENCE_END.finditer(text.rstrip())]
    q, a = (words(text[: cut[-1]]), words(text[cut[-1] :])) if cut else ([], [])
    if not q or not a:
        w = words(text)
        at = max(1, len(w) * 3 // 4)
        q, a = w[:at], w[at:]
    return q, a


def ngrams(w: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


class Codes(dict):
    """White-space token -> the number of its only word in a vocabulary (-1 if unknown), or ``base + k`` for ``several[k]``.

    Words never span white space, so a text's words are those of its tokens; most tokens come again and again.
    """

    def __init__(self, vocab: dict[str, int], most: int = 32 << 20):
        super().__init__()
        self.vocab, self.base, self.most, self.taken = vocab, len(vocab), most, 0
        self.several: list[list[int]] = []

    def __missing__(self, token: str) -> int:
        self.taken += 8 * len(token) + 160  # a token of many words keeps their numbers
        own = [self.vocab.get(w, -1) for w in words(token)]
        if len(own) == 1:
            code = own[0]
        else:
            code = self.base + len(self.several)
            self.several.append(own)
        self[token] = code
        return code

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts one after another, and how many words each has."""
        if self.taken > self.most:  # bytes; a batch is bounded too
            self.clear()
            self.several.clear()
            self.taken = 0
        tokens = [t.split() if t else [] for t in texts]
        n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(tokens)), np.int64, int(n.sum()))
        odd = codes >= self.base
        if odd.any():
            size = np.ones(codes.size, np.int64)
            size[odd] = np.fromiter(map(len, self.several), np.int64, len(self.several))[codes[odd] - self.base]
            out = np.repeat(codes, size)
            first = np.cumsum(size) - size
            for i in np.flatnonzero(odd & (size > 0)):
                out[first[i] : first[i] + size[i]] = self.several[codes[i] - self.base]
            total = np.concatenate(([0], np.cumsum(size)))
            at = np.concatenate(([0], np.cumsum(n)))
            return out, total[at[1:]] - total[at[:-1]]
        return codes, n


class Shard:
    """The inverted index of a bounded number of items."""

    def __init__(self, items: list[tuple[object, str]], df: dict[str, int], n_items: int, mean_len: float, threshold: float, overlap: float, n: int):
        self.threshold, self.overlap, self.n = threshold, overlap, n
        self.ids = [i for i, _ in items]
        tokens = [words(t) for _, t in items]
        parts = [split_item(t) for _, t in items]
        self.whole = [tuple(w) if len(w) < n else None for w in tokens]
        self.question = [ngrams(q, n) for q, _ in parts]
        self.answer = [ngrams(a, n) for _, a in parts]
        self.stride = max([MIN_STRIDE, *map(len, tokens)])
        self.vocab: dict[str, int] = {}
        term, item, impact = [], [], []
        self.raw = np.zeros(len(items))
        for i, w in enumerate(tokens):
            norm = K1 * (1 - B + B * len(w) / max(mean_len, 1e-9))
            own = {}
            for t in w:
                own[t] = own.get(t, 0) + 1
            scores = {t: np.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in own.items()}
            self.raw[i] = sum(scores.values())
            for t, s in scores.items():
                term.append(self.vocab.setdefault(t, len(self.vocab)))
                item.append(i)
                impact.append(s / self.raw[i])
        self.n_items, n_terms = len(items), len(self.vocab)
        term, item, impact = np.array(term, np.int64), np.array(item, np.int64), np.array(impact, float)
        order = np.lexsort((item, term))
        self.item, self.impact = item[order], impact[order]
        self.at = np.searchsorted(term[order], np.arange(n_terms + 1))
        # non-essential words: the longest lists first, while no item owes them more than REST of its score
        rest, self.essential = np.zeros(self.n_items), np.ones(n_terms, bool)
        for t in np.argsort(-np.diff(self.at), kind="stable"):
            a, b = self.at[t], self.at[t + 1]
            if b - a < 2 or (rest[self.item[a:b]] + self.impact[a:b] > min(REST, threshold / 2)).any():
                continue
            rest[self.item[a:b]] += self.impact[a:b]
            self.essential[t] = False
        self.essential = np.append(self.essential, False)  # number -1: an unknown word
        self.codes: Codes | None = None  # each worker's own
        self.n_blocks = -(-self.n_items // BLOCK)
        self.block_rest = np.zeros(self.n_blocks)
        np.maximum.at(self.block_rest, np.arange(self.n_items) // BLOCK, rest)
        self.batch_bytes = max(1 << 18, min(1 << 22, (1 << 28) // max(self.n_blocks, 1)))
        # the postings by block and word, for exact scores
        order = np.lexsort((self.item, np.repeat(np.arange(n_terms), np.diff(self.at)), self.item // BLOCK))
        by_block = (self.item // BLOCK * n_terms + np.repeat(np.arange(n_terms), np.diff(self.at)))[order]
        self.exact_item, self.exact_impact = self.item[order], self.impact[order]
        self.exact_key = by_block
        # block-max postings of the essential words
        key = np.repeat(np.arange(n_terms), np.diff(self.at)) * max(self.n_blocks, 1) + self.item // BLOCK
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if key.size else np.empty(0, np.int64)
        self.max_block = (self.item // BLOCK)[starts]
        self.max_impact = np.maximum.reduceat(self.impact, starts) if key.size else np.empty(0)
        self.max_at = np.searchsorted(key[starts], np.arange(n_terms + 1) * max(self.n_blocks, 1))

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, int, float, float]]:
        """(text, item, score, passage start, question overlap, answer overlap) of the verified hits in a batch of texts."""
        found = []
        if not self.vocab:
            return found
        if self.codes is None:
            self.codes = Codes(self.vocab)
        ids, sizes = self.codes.read(texts)
        base = np.concatenate(([0], np.cumsum(sizes)))
        first = np.concatenate(([0], np.cumsum(-(-sizes // self.stride))))
        hit = np.flatnonzero(self.essential[ids])
        owner = np.searchsorted(base, hit, side="right") - 1
        span = first[owner] + (hit - base[owner]) // self.stride
        # a passage is a stride and the next one of its text; it is numbered by its first stride
        again = span > first[owner]
        pairs = np.concatenate((span, span[again] - 1)) * len(self.vocab) + np.concatenate((ids[hit], ids[hit[again]]))
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: pairs.size]]
        passage, term = pairs // len(self.vocab), pairs % len(self.vocab)
        n = self.max_at[term + 1] - self.max_at[term]
        at = np.repeat(self.max_at[term] - np.concatenate(([0], np.cumsum(n)[:-1]))[: n.size], n) + np.arange(n.sum())
        low = int(passage[0]) if passage.size else 0
        key = np.repeat(passage - low, n) * self.n_blocks + self.max_block[at]
        bound = np.bincount(key, self.max_impact[at])
        bound += np.resize(self.block_rest, bound.size)
        seen_text, seen_words = -1, []
        for k in np.flatnonzero(bound >= self.threshold - 1e-9):
            p, block = divmod(int(k), self.n_blocks)
            p += low
            text = int(np.searchsorted(first, p, side="right")) - 1
            start = (p - int(first[text])) * self.stride
            terms = np.unique(ids[base[text] + start : min(base[text] + start + 2 * self.stride, base[text + 1])])
            want = terms[terms >= 0] + block * len(self.vocab)
            lo, hi = np.searchsorted(self.exact_key, want), np.searchsorted(self.exact_key, want, side="right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            scores = np.bincount(self.exact_item[at], self.exact_impact[at], minlength=self.n_items)
            good = np.flatnonzero(scores[block * BLOCK : (block + 1) * BLOCK] >= self.threshold - 1e-9) + block * BLOCK
            if not good.size:
                continue
            if seen_text != text:
                seen_text, seen_words = text, words(texts[text])
            passage_words = seen_words[start : start + 2 * self.stride]
            grams: dict[int, set] = {}

            def share(want: set, w=passage_words, seen=grams) -> float:
                if not want:
                    return 1.0
                size = len(next(iter(want)))
                if size not in seen:
                    seen[size] = ngrams(w, size) if len(w) >= size else set()
                return len(want & seen[size]) / len(want)

            for i in good:
                q, s = share(self.question[i]), share(self.answer[i])
                if self.whole[i] is not None and share({self.whole[i]}) < 1:
                    continue
                if q >= self.overlap and s >= self.overlap:
                    found.append((text, int(i), float(scores[i]), start, q, s))
        return found


def shards(items: DataFrame, item_id: str, text: str, threshold: float, overlap: float, n: int, shard_bytes: int) -> Iterator[Shard]:
    """Index all items, a bounded shard at a time; equal rows count once."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null").distinct()

    def count(frames):
        for f in frames:
            tokens = [words(t) for t in f["t"]]
            yield pd.DataFrame([(w, 1, 0) for t in tokens for w in set(t)] + [(None, int(len(t) > 0), len(t)) for t in tokens], columns=["w", "n", "len"])

    stats = rows.mapInPandas(count, "w string, n long, len long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
    total = stats.where("w is null").first()
    if not total or not total["n"]:
        return
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    k = -(-size // shard_bytes)
    for s in range(k):
        part = rows if k == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(k)) == s)
        got = [(r["i"], r["t"]) for r in part.orderBy("i", "t").toLocalIterator() if words(r["t"])]
        own = {w for _, t in got for w in words(t)}
        known = stats.where("w is not null")
        df = {r["w"]: r["n"] for r in (known if k == 1 else known.join(F.broadcast(items.sparkSession.createDataFrame([(w,) for w in own] or [("",)], "w string")), "w")).toLocalIterator()}
        yield Shard(got, df, total["n"], total["len"] / total["n"], threshold, overlap, n)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.6, n: int = 5, shard_bytes: int = 8 << 20) -> DataFrame:
    """One row for each document and item it leaks: doc_id, item_id, score, position, question_overlap, answer_overlap.

    ``score`` is the best passage's BM25 score as a share of the item's own, ``position`` the word at which that
    passage starts.
    """
    rows, out = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")), None
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double, position long, question_overlap double, answer_overlap double"
    for shard in shards(items, "item_id", "text", threshold, overlap, n, shard_bytes):
        shared = shipped(docs.sparkSession, shard)

        def scan(batches, shared=shared):
            index = received(shared)
            for batch in bounded(batches, "text", index.batch_bytes):
                doc = batch.column("doc_id")
                hits = index.search(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array([h[0] for h in hits], pa.int64())), pa.array([index.ids[h[1]] for h in hits], doc_item), *(pa.array([h[k] for h in hits], kind) for k, kind in ((2, pa.float64()), (3, pa.int64()), (4, pa.float64()), (5, pa.float64())))],
                    ["doc_id", "item_id", "score", "position", "question_overlap", "answer_overlap"],
                )

        from pyspark.sql.pandas.types import to_arrow_type

        doc_item = to_arrow_type(items.schema["item_id"].dataType)
        part = rows.mapInArrow(scan, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("position")).alias("p"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", (-F.col("b.p")).alias("position"), "b.question_overlap", "b.answer_overlap")


def leaks_any(docs: DataFrame, shard: Shard, text: str) -> Column:
    """Whether a text leaks an item of the shard."""
    shared = shipped(docs.sparkSession, shard)

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = received(shared)
        for texts in batches:
            out, at = np.zeros(len(texts), bool), 0
            for some in by_run(texts, index.batch_bytes):
                out[[at + h[0] for h in index.search(some)]] = True
                at += len(some)
            yield pd.Series(out)

    return found(F.col(text))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.6, n: int = 5, shard_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` (all columns) that leak no item."""
    for shard in shards(items, "item_id", "text", threshold, overlap, n, shard_bytes):
        docs = docs.where(~leaks_any(docs, shard, "text"))
    return docs
