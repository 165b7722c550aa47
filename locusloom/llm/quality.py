"""Quality classifier: a byte-level convolutional network written in numpy.

A text's UTF-8 bytes are embedded, learned filters of ``WIDTH`` bytes slide over them by ``STEP``, and rectified
responses are max-pooled inside overlapping chunks of ``CHUNK`` bytes (a new one each ``CHUNK // 2`` bytes) which cover the whole
document. A linear layer turns each chunk's pooled features into a logit; the mean of the logits gives the document's
probability.

Edge cases: null and empty texts are scored as one padded chunk; a null or repeated id changes nothing but the fold;
labels other than 0 and 1 and unlabelled rows don't train; without both classes in training every score is the share
of label 1 (0.5 with no label at all). Ties can't arise; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_run, received, shipped
from .langid import held_out_fold

WIDTH, STEP, DIM, FILTERS, CHUNK = 8, 2, 8, 32, 512
HALF = CHUNK // 2 // STEP  # filter positions in half a chunk
BATCH = 1 << 16  # bytes convolved at once


def as_bytes(text: str | None) -> bytes:
    """UTF-8, padded to whole steps and at least one filter width, so that each text has a response."""
    b = (text or "").encode("utf-8", "replace")
    return b + b"\0" * (max(WIDTH, len(b) + len(b) % STEP) - len(b))


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.conv = r.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, FILTERS**-0.5, FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.constant: float | None = None

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Rectified filter responses at every ``STEP`` bytes of an array."""
        e = np.ascontiguousarray(self.embed[data])
        view = np.lib.stride_tricks.as_strided(e, ((data.size - WIDTH) // STEP + 1, WIDTH * DIM), (e.strides[0] * STEP, e.strides[1]), writeable=False)
        y = np.ascontiguousarray(view) @ self.conv  # BLAS takes no overlapping rows
        y += self.bias
        return np.maximum(y, 0, out=y)

    def logit(self, text: str | None) -> float:
        """Of one document, over all its chunks; long texts go through in pieces of whole half-chunks."""
        data = np.frombuffer(as_bytes(text), np.uint8)
        halves = []
        for a in range(0, max(1, data.size - WIDTH + 1), BATCH):
            y = self.responses(data[a : a + BATCH + WIDTH - STEP])
            halves.append(np.maximum.reduceat(y, np.arange(0, len(y), HALF), axis=0))
        return float(self._chunk_logits(np.concatenate(halves)).mean())

    def _chunk_logits(self, halves: np.ndarray) -> np.ndarray:
        pooled = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
        return pooled @ self.out + self.shift

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Of many documents: short ones share a convolution, each starting on a half-chunk of its own."""
        out, batch, size = np.zeros(len(texts)), [], 0
        for i, t in enumerate([*texts, None]):
            b = as_bytes(t)
            if batch and (i == len(texts) or size + len(b) > BATCH):
                self._together(batch, out)
                batch, size = [], 0
            if i == len(texts):
                break
            if len(b) > BATCH:
                out[i] = self.logit(t)
                continue
            batch.append((i, b))
            size += len(b)
        return out

    def _together(self, batch: list[tuple[int, bytes]], out: np.ndarray) -> None:
        data = np.frombuffer(b"".join(b for _, b in batch), np.uint8)
        y = self.responses(data)
        starts, at, owner = [], 0, []
        for k, (_, b) in enumerate(batch):
            end = at + (len(b) - WIDTH) // STEP + 1
            own = np.arange(at, end, HALF)
            starts.append(own)
            owner.append(np.full(own.size, k))
            at += len(b) // STEP
            if k + 1 < len(batch):  # positions that straddle two texts belong to neither
                starts.append(np.array([end]))
                owner.append(np.array([-1]))
        starts, owner = np.concatenate(starts), np.concatenate(owner)
        halves = np.maximum.reduceat(y, starts, axis=0)[owner >= 0]
        owner = owner[owner >= 0]
        pooled = halves.copy()
        pair = owner[:-1] == owner[1:]
        pooled[:-1][pair] = np.maximum(halves[:-1][pair], halves[1:][pair])
        first = np.append(True, ~pair)
        last = np.append(~pair, True)
        keep = ~last | first  # each half starts a chunk with the next one; the last doesn't, unless it is alone
        sums = np.bincount(owner[keep], pooled[keep] @ self.out + self.shift[0], minlength=len(batch))
        for (i, _), x in zip(batch, sums / np.bincount(owner[keep], minlength=len(batch)), strict=True):
            out[i] = x

    def predict(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))


def train(chunks: np.ndarray, labels: np.ndarray, prior: float, epochs: int = 8, rate: float = 0.004, seed: int = 11) -> Network:
    """Adam on the logistic loss of single chunks, classes weighted alike; the bias then gets the prior back."""
    net, r = Network(seed), np.random.default_rng(seed)
    params = [net.embed, net.conv, net.bias, net.out, net.shift]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)).astype(np.float32)
    step, size = 0, 64
    for epoch in range(epochs):
        order = r.permutation(len(chunks))
        for a in range(0, len(order), size):
            x, y, w = chunks[order[a : a + size]], labels[order[a : a + size]], weight[order[a : a + size]]
            e = np.ascontiguousarray(net.embed[x])
            n, length = x.shape
            view = np.lib.stride_tricks.as_strided(e, (n, (length - WIDTH) // STEP + 1, WIDTH * DIM), (e.strides[0], e.strides[1] * STEP, e.strides[2]), writeable=False)
            z = (view.reshape(-1, WIDTH * DIM) @ net.conv).reshape(n, -1, FILTERS) + net.bias
            top = z.argmax(axis=1)  # n x filters
            peak = np.take_along_axis(z, top[:, None, :], axis=1)[:, 0, :]
            pooled = np.maximum(peak, 0)
            p = 1 / (1 + np.exp(-(pooled @ net.out + net.shift[0])))
            g = ((p - y) * w / n).astype(np.float32)
            d_pool = g[:, None] * net.out[None, :] * (peak > 0)
            windows = view[np.arange(n)[:, None], top]  # n x filters x width*dim
            d_conv = np.einsum("nf,nfk->kf", d_pool, windows)
            d_in = (d_pool[:, :, None] * net.conv.T[None]).reshape(-1, DIM)
            d_embed = np.zeros_like(net.embed)
            at = x[np.arange(n)[:, None, None], STEP * top[:, :, None] + np.arange(WIDTH)].reshape(-1)
            np.add.at(d_embed, at, d_in)
            grads = [d_embed, d_conv, d_pool.sum(axis=0), g @ pooled, np.array([g.sum()], np.float32)]
            step += 1
            lr = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
            for q, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                q -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.shift += np.float32(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    return net


def fit(labelled: DataFrame, max_docs_per_class: int = 1500, max_chunks_per_doc: int = 4, seed: int = 11) -> Network:
    """Fit on ``text`` and ``quality`` (0 or 1) of ``labelled``.

    The driver trains on a documented bounded sample: at most ``max_docs_per_class`` documents of each label, those
    with the smallest seeded hash of the text, and of each at most ``max_chunks_per_doc`` evenly spread chunks and one shorter piece.
    """
    rows = labelled.where(F.col("quality").isin(0, 1)).select(F.coalesce("text", F.lit("")).alias("text"), F.col("quality").alias("quality"))
    n = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    if len(n) < 2:
        net = Network(seed)
        net.constant = float(next(iter(n), 0.5))
        return net

    def cut(batches):
        for frame in batches:
            out = []
            for text, y in zip(frame["text"], frame["quality"], strict=True):
                data = as_bytes(text)
                k = max(1, min(max_chunks_per_doc, -(-len(data) // CHUNK)))
                for j in range(k):
                    a = int((len(data) - CHUNK) * j / max(1, k - 1)) if len(data) > CHUNK else 0
                    out.append((data[a : a + CHUNK], int(y)))
                size = 16 + STEP * (zlib.crc32(data) % 96)  # one short piece, as short documents are to be told too
                a = STEP * (zlib.crc32(data[::-1]) % max(1, (len(data) - size) // STEP + 1)) if len(data) > size else 0
                out.append((data[a : a + size], int(y)))
            yield pd.DataFrame(out, columns=["b", "y"])

    parts = []
    for y in (0, 1):
        own = rows.where(F.col("quality") == y)
        share = min(1.0, 1.5 * max_docs_per_class / n[y] + 100 / n[y])
        own = own.where(F.shiftrightunsigned(F.xxhash64("text", F.lit(seed)), 34) < int(share * (1 << 30)))
        ids = own.select(F.xxhash64("text", F.lit(seed)).alias("h"), "text", "quality").orderBy("h", "text").limit(max_docs_per_class)
        parts.append(ids.select("text", "quality").mapInPandas(cut, "b binary, y int").toPandas())
    data = pd.concat(parts)
    chunks = np.zeros((len(data), CHUNK), np.uint8)
    for i, b in enumerate(data["b"]):
        chunks[i] = np.resize(np.frombuffer(b, np.uint8), CHUNK)  # a short text repeats: padding must not tell the label
    return train(chunks, data["y"].to_numpy(np.float32), n[1] / (n[0] + n[1]), seed=seed)


def predict(net: Network, df: DataFrame, text: str = "text") -> Column:
    shared = shipped(df.sparkSession, net)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = received(shared)
        for texts in batches:
            yield pd.Series(np.concatenate([own.predict(some) for some in by_run(texts)] or [np.empty(0)]))

    return score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``; labels of fold 2 of 4 are never read."""
    marks = labels.where(~held_out_fold("doc_id", 4, 2)).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    net = fit(docs.select("doc_id", "text").join(marks, "doc_id"))
    rows = docs.select("doc_id", held_out_fold("doc_id", 4, 2).alias("held_out"), predict(net, docs).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
