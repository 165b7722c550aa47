"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of code points that are not letters becomes one space, and a space stands at
both ends. The n-grams of 1 to 3 code points are hashed into ``BUCKETS`` buckets. The matrix of log-probabilities
(buckets x languages) is broadcast; a batch of texts is scored by gathering its rows and adding them by text.

Edge cases: a null text, an empty one, or one without a letter is ``und`` with score 0. Rows with a null language or
text don't train. With nothing to learn from, every text is ``und``. Ties go to the alphabetically first language.
Repeated rows are scored alike; other columns are ignored by name and kept by :func:`keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_run, received, shipped

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
CHUNK = 1 << 19  # code points scored at once
UND = "und"
_LETTER: np.ndarray | None = None
_SEEN: np.ndarray | None = None


def _letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters; asks Python once for each 256 of them that occur."""
    global _LETTER, _SEEN
    if _LETTER is None:
        _LETTER, _SEEN = np.zeros(0x110000, bool), np.zeros(0x1100, bool)
    pages = points >> np.uint32(8)
    if not _SEEN[pages].all():
        for p in np.unique(pages):
            if not _SEEN[p]:
                _LETTER[int(p) << 8 : (int(p) + 1) << 8] = [chr(i).isalpha() for i in range(int(p) << 8, (int(p) + 1) << 8)]
                _SEEN[p] = True
    return _LETTER[points]


def normalise(text: str | None) -> np.ndarray:
    """Code points of a text as the model sees them; empty if there is no letter."""
    if not text:
        return np.empty(0, np.uint32)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = _letters(points)
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space after a letter
    keep[0] = True
    points = points[keep]
    return points if points.size > 1 else np.empty(0, np.uint32)


def grams(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(orders, positions) bucket of each n-gram; BUCKETS where it would cross into the next text or is a lone space."""
    n = points.size
    left = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))) - np.arange(n)  # code points up to the end of the text
    out = np.full((len(ORDERS), n), BUCKETS, np.int32)
    h = np.zeros(n, np.uint32)
    for k, order in enumerate(range(1, max(ORDERS) + 1)):
        h[: n - k] = (h[: n - k] ^ points[k:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if order in ORDERS:
            ok = left >= order
            if order == 1:
                ok &= points != 32
            row = ORDERS.index(order)
            out[row, ok] = ((h[ok] * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int32)
    return out


def _chunks(texts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + t.size > CHUNK:
            yield start, i
            start, total = i, 0
        total += t.size
    if texts:
        yield start, len(texts)


def gram_sums(texts: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Sum of the matrix rows of each text's n-grams."""
    out = np.zeros((len(texts), matrix.shape[1]))
    for a, b in _chunks(texts):
        full = [i for i in range(a, b) if texts[i].size]
        if not full:
            continue
        lengths = np.array([texts[i].size for i in full])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        for row in grams(np.concatenate([texts[i] for i in full]), starts):
            out[full] += np.add.reduceat(matrix.take(row, axis=0), starts, axis=0)
    return out


class Model:
    """Languages in ascending order and the (BUCKETS + 1) x languages log-probabilities; the last row is 0."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, alpha: float = 0.1):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        logs = np.log((counts + alpha) / (total + alpha * BUCKETS)).T
        self.matrix = np.vstack([logs, np.zeros((1, len(langs)))])
        self.prior = np.log(np.maximum(docs, 1) / max(docs.sum(), 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        points = [normalise(t) for t in texts]
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        logs = gram_sums(points, self.matrix) + self.prior
        best = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        known = np.array([p.size > 0 for p in points], bool)
        return [self.langs[b] if k else UND for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fit(labelled: DataFrame, max_docs_per_lang: int = 4000, alpha: float = 0.1, seed: int = 7, max_model_bytes: int = 64 << 20) -> Model:
    """Fit on ``text`` and ``lang`` of ``labelled``.

    Training takes a documented bounded sample: about ``max_docs_per_lang`` different whole texts of each language, those
    with the smallest share of a seeded hash of the text; a language with fewer texts is used whole, and a text that is
    repeated counts once. The matrix, which is broadcast, may take ``max_model_bytes``; more languages are an error.
    """
    rows = labelled.select(F.col("lang").alias("lang"), F.col("text").alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))
    most = max_model_bytes // (8 * BUCKETS)
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: the log-probability matrix would take over {max_model_bytes} bytes")
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, max_docs_per_lang / n) * (1 << 30)))])
    sample = rows.where((F.shiftrightunsigned("h", 34) < share[F.col("lang")])).dropDuplicates(["lang", "h"]).select("lang", "text")
    langs = sorted(sizes)

    def count(frames):
        total, docs = np.zeros((len(langs), BUCKETS + 1), np.int64), np.zeros(len(langs), np.int64)
        for frame in frames:
            for lang, group in frame.groupby("lang"):
                i = langs.index(lang)
                for texts in by_run(group["text"]):
                    points = [p for t in texts if (p := normalise(t)).size]
                    docs[i] += len(points)
                    for a, b in _chunks(points):
                        lengths = np.array([p.size for p in points[a:b]])
                        for row in grams(np.concatenate(points[a:b]), np.concatenate(([0], np.cumsum(lengths)[:-1]))):
                            total[i] += np.bincount(row, minlength=BUCKETS + 1)
        for i in range(len(langs)):
            at = np.flatnonzero(total[i, :BUCKETS])
            yield pd.DataFrame({"i": [i], "docs": [int(docs[i])], "at": [at.astype("<i4").tobytes()], "n": [total[i, at].astype("<i8").tobytes()]})

    counts, docs = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    for r in sample.mapInPandas(count, "i int, docs long, at binary, n binary").toLocalIterator():
        counts[r["i"], np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["n"], "<i8")
        docs[r["i"]] += r["docs"]
    return Model(langs, counts, docs, alpha)


def predict(model: Model, df: DataFrame, text: str = "text") -> Column:
    """A struct(lang_pred, score) column for the texts of ``df``."""
    shared = shipped(df.sparkSession, model)

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = received(shared)
        for texts in batches:
            got = [own.predict(some) for some in by_run(texts)]
            yield pd.DataFrame({"lang_pred": [x for langs, _ in got for x in langs], "score": np.concatenate([s for _, s in got] or [np.empty(0)])})

    return score(F.col(text))


def held_out_fold(doc_id: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, max_docs_per_lang: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; trains on the rows that are not held out (fold 0 of 5; a null id is not held out)."""
    rows = docs.select("doc_id", "text", "lang", held_out_fold("doc_id", 5, 0).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), max_docs_per_lang)
    return rows.select("doc_id", "held_out", predict(model, rows).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all its columns) whose language is recognised: not ``und``, and score >= ``min_score``."""
    model = fit(docs.where(~held_out_fold("doc_id", 5, 0)))
    return docs.where(predict(model, docs)["score"] >= min_score)
