"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Shares: each source's tokens (white-space words) over all tokens. Weights: shares to the power ``alpha``, normalised.
``alpha`` starts at 1 (proportional) and is bisected down until the weights' entropy reaches ``entropy`` (a share of
the most that the number of sources allows); ``max_repeats`` bounds how often a source's tokens may be read, and
where that bound is passed ``alpha`` is bisected up to the smallest value that keeps to it. The bound wins over the
entropy. The budget (``budget_tokens``, by default all tokens of the corpus) is divided by the weights.

Realisation: a source's documents are dealt into blocks by a seeded hash, ``blocks`` of them for the whole corpus and
at least one for each source, in proportion to its tokens; for each epoch its blocks, and the documents in a block, are
permuted by another seeded hash. Whole epochs come first; in the
last one blocks are taken in order until the budget is met, and only the block that meets it is cut, after the
document that reaches the budget. ``mix_pos`` (0 to 1) is the share of its source's budget that precedes a block:
reading in the order of mix_pos, epoch, block, order_in_block has every source at its weight all along.

Scale: texts never move; documents are counted into one row for each (source, block), prefix sums run over blocks and
not over a source's documents, and only hashes and sizes of the documents of cut blocks (one for each source) are
ranked, to find the last one read. What is broadcast is the table of sources and that of blocks: at most
``blocks + max_sources`` rows for each epoch, however large the corpus. Only the table of sources reaches the driver (at
most ``max_sources`` rows, else an error).

Edge cases: a null source is a source of its own; documents without words count 0 tokens, belong to a block and are
taken with it; a source without any tokens has weight 0 and is left out; one source has weight 1; null ids are documents
of their own; repeated rows (equal id and text) are counted each but read together; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TOKENS = r"[^\x20\x09-\x0D]+"


def tempered(tokens: list[int], alpha: float) -> list[float]:
    top = max(tokens, default=0)
    raw = [math.exp(alpha * math.log(t / top)) if t else 0.0 for t in tokens]
    total = sum(raw) or 1.0
    return [r / total for r in raw]


def entropy_of(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def repeats_of(weights: list[float], tokens: list[int], budget: int) -> float:
    return max((w * budget / t for w, t in zip(weights, tokens, strict=True) if t), default=0.0)


def _bisect(ok, lo: float, hi: float) -> float:
    """The point where ``ok`` changes from true at ``lo`` to false at ``hi``, on the true side."""
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def solve(tokens: list[int], budget: int, entropy: float = 0.97, max_repeats: float = 4.0) -> tuple[float, list[float]]:
    """The exponent and the weights of the sources with so many tokens each."""
    alive = sum(t > 0 for t in tokens)
    if not alive:
        return 1.0, [0.0] * len(tokens)
    want = entropy * math.log(alive)
    alpha = 1.0
    if entropy_of(tempered(tokens, 1.0)) < want:
        alpha = _bisect(lambda a: entropy_of(tempered(tokens, a)) >= want, 0.0, 1.0)
    total = sum(tokens)
    if repeats_of(tempered(tokens, alpha), tokens, budget) > max_repeats:
        if budget > max_repeats * total:
            raise ValueError(f"a budget of {budget} tokens repeats even a proportional mix of {total} more than {max_repeats} times")
        alpha = 1.0 - _bisect(lambda b: repeats_of(tempered(tokens, 1.0 - b), tokens, budget) <= max_repeats, 0.0, 1.0 - alpha)
    return alpha, tempered(tokens, alpha)


def apportion(weights: list[float], budget: int) -> list[int]:
    """Whole tokens for each weight, by largest remainders; they add up to the budget."""
    if not any(weights):
        return [0] * len(weights)
    exact = [w * budget for w in weights]
    out = [math.floor(x) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))
    for i in order[: budget - sum(out)]:
        out[i] += 1
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENS)), F.lit(0)).cast("long")


def _key(seed: int) -> Column:
    """A document's place in all permutations; equal rows share it."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def plan(docs: DataFrame, budget_tokens: int | None = None, entropy: float = 0.97, max_repeats: float = 4.0, max_sources: int = 10_000) -> DataFrame:
    """One row for each source: source, tokens, share, alpha, weight, budget, repeats."""
    return _plan(docs.select(F.col("source").alias("source"), word_count(F.col("text")).alias("n")), budget_tokens, entropy, max_repeats, max_sources)


def _plan(sized: DataFrame, budget_tokens: int | None, entropy: float, max_repeats: float, max_sources: int) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("n").alias("tokens"))
    got = [(r["source"], r["tokens"]) for r in sizes.limit(max_sources + 1).collect()]
    if len(got) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    got.sort(key=lambda r: (r[0] is not None, r[0]))
    tokens = [t for _, t in got]
    total = sum(tokens)
    budget = total if budget_tokens is None else budget_tokens
    alpha, weights = solve(tokens, budget, entropy, max_repeats)
    rows = [(s, t, t / total if total else 0.0, alpha, w, b, b / t if t else 0.0) for (s, t), w, b in zip(got, weights, apportion(weights, budget), strict=True)]
    kind = sized.schema["source"].dataType.simpleString()
    return sized.sparkSession.createDataFrame(rows, f"source {kind}, tokens long, share double, alpha double, weight double, budget long, repeats double")


def mix(docs: DataFrame, columns: list[str] | None = None, budget_tokens: int | None = None, entropy: float = 0.97, max_repeats: float = 4.0, blocks: int = 1 << 16, seed: int = 17, max_sources: int = 10_000) -> DataFrame:
    """The mix, one row for each reading of a document: struct ``row`` with the given columns of ``docs`` (default all),
    and source, n_tokens, weight, epoch, block, mix_pos, order_in_block."""
    slim = materialise(docs.select(F.col("source").alias("source"), word_count(F.col("text")).alias("n"), _key(seed).alias("h")), "mixing")
    p = _plan(slim.select("source", "n"), budget_tokens, entropy, max_repeats, max_sources)
    total = max(1, sum(r["tokens"] for r in p.select("tokens").collect()))
    sources = p.where("budget > 0").select(F.col("source").alias("s"), "weight", "budget", "tokens", F.ceil(F.col("tokens") / F.lit(total) * F.lit(blocks)).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("h")), F.col("blocks"))
    order = F.xxhash64(F.lit(seed + 3), "epoch", "h")

    dealt = slim.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s")))
    cells = dealt.groupBy("s", "weight", "budget", "tokens", "blocks", block.alias("block")).agg(F.sum("n").alias("size"))
    cells = cells.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("budget") - 1) / F.col("tokens")).cast("int"))))
    before = Window.partitionBy("s", "epoch").orderBy(F.xxhash64(F.lit(seed + 2), "epoch", "block", "s"), "block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("at", F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("size").over(before), F.lit(0))).where("at < budget")
    cells = materialise(cells.select("s", "weight", "budget", F.col("block").alias("b"), "epoch", "at", (F.col("at") + F.col("size") > F.col("budget")).alias("cut")), "mixing-blocks")

    # where a cut block ends: the last document that begins before the budget is reached
    own = dealt.select("source", "n", "h", block.alias("block")).join(F.broadcast(cells.where("cut")), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    own = own.groupBy("s", "epoch", "b", "at", "budget", "h").agg(F.sum("n").alias("n")).withColumn("o", order)
    own = own.withColumn("to", F.sum("n").over(Window.partitionBy("s", "epoch", "b").orderBy("o", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = own.where(F.col("at") + F.col("to") - F.col("n") < F.col("budget")).groupBy("s", "epoch", "b").agg(F.max(F.struct("o", "h")).alias("last"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"l.{k}")) for k in ("s", "epoch", "b")]
    cells_cut = materialise(cells.alias("c").join(F.broadcast(last).alias("l"), same[0] & same[1] & same[2], "left").select("c.*", "l.last"), "mixing-cells")

    keep = columns or docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("source").alias("source"), F.col("text").alias("text"), _key(seed).alias("h"))
    rows = rows.join(F.broadcast(sources.select(F.col("s").alias("s0"), "blocks")), F.col("source").eqNullSafe(F.col("s0"))).withColumn("block", block)
    rows = rows.join(F.broadcast(cells_cut), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    rows = rows.where(~F.col("cut") | (F.struct(order.alias("o"), "h") <= F.col("last")))
    return rows.select("row", "source", word_count(F.col("text")).alias("n_tokens"), "weight", "epoch", "block", (F.col("at") / F.col("budget")).alias("mix_pos"), order.alias("order_in_block"))


def resample(docs: DataFrame, **how) -> DataFrame:
    """The columns of ``docs``, each row as often as the mix reads it."""
    return mix(docs, **how).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def readings(docs: DataFrame, **how) -> DataFrame:
    """doc_id and how the mix reads it: source, n_tokens, weight, epoch, block, mix_pos, order_in_block."""
    return mix(docs, ["doc_id"], **how).select("row.doc_id", "source", "n_tokens", "weight", "epoch", "block", "mix_pos", "order_in_block")
