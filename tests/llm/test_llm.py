"""The corpus operators against brute force, exact round trips and planted cases, on small tables."""

import collections
import hashlib
import io
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from locusloom.llm import decontam, fingerprint, langid, mixing, neardup, quality, substring, tokenbin, warc
from locusloom.llm.common import hashed_words, range_parts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
VOCAB = "the of and river stone cloud winter garden paper window silver morning letter bridge forest shadow summer candle harbor meadow copper violet thunder ribbon lantern marble orchard feather compass anchor".split()
STYLES = {"en": VOCAB, "de": "der und nicht straße größe vögel schöne türen häuser wege gärten müde über würde könnte".split()}


def prose(seed: int, n: int, words=VOCAB) -> list[str]:
    r = random.Random(seed)
    return [r.choice(words) for _ in range(n)]


def docs_of(spark, texts, **extra):
    """Rows of ``documents``; also a column whose name clashes with the operators' own."""
    rows = [(i, t, extra.get("lang", "en"), f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("x")).withColumn("block", F.lit(1)).withColumn("rid", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated texts."""
    long = " ".join(prose(5, 9000))
    return docs_of(spark, [None, "", " \n ", "same text here", "same text here", long, long + " end", "12 34"])


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1: mixing


def test_mixing_weights_meet_targets():
    tokens = [9000, 500, 300, 200]
    alpha, w = mixing.solve(tokens, 10000, entropy=0.9, max_repeats=50)
    assert 0 < alpha < 1 and abs(sum(w) - 1) < 1e-12
    assert abs(mixing.entropy_of(w) - 0.9 * math.log(4)) < 1e-6
    alpha2, w2 = mixing.solve(tokens, 10000, entropy=0.9, max_repeats=2.0)
    assert alpha2 > alpha and mixing.repeats_of(w2, tokens, 10000) <= 2.0 + 1e-9
    assert mixing.repeats_of(mixing.tempered(tokens, alpha2 - 1e-6), tokens, 10000) > 2.0
    assert mixing.solve([5, 5], 10)[0] == 1.0
    assert sum(mixing.apportion([0.3, 0.3, 0.4], 11)) == 11
    with pytest.raises(ValueError):
        mixing.solve([5, 5], 1000, max_repeats=3)


def test_mixing_realises_budgets(spark):
    texts, sources = [], []
    for i in range(300):
        sources.append("big" if i < 220 else f"s{i % 4}")
        texts.append(" ".join(prose(i, 5 + i % 40)))
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (t, s) in enumerate(zip(texts, sources))], DOCS)
    plan = {r["source"]: r for r in mixing.plan(df, entropy=0.95).collect()}
    rows = mixing.readings(df, entropy=0.95, blocks=36).collect()
    n = {i: len(t.split()) for i, t in enumerate(texts)}
    got, times = collections.Counter(), collections.Counter()
    for r in rows:
        got[r["source"]] += r["n_tokens"]
        times[r["doc_id"], r["epoch"]] += 1
        assert r["n_tokens"] == n[r["doc_id"]] and r["source"] == sources[r["doc_id"]] and 0 <= r["mix_pos"] < 1
    assert max(times.values()) == 1  # once in each epoch at most
    for s, p in plan.items():
        assert p["budget"] <= got[s] < p["budget"] + 50  # the document that reaches the budget is the last
    whole = collections.defaultdict(set)
    for r in rows:
        whole[r["source"], r["epoch"]].add(r["doc_id"])
    for (s, e), ids in whole.items():
        if (s, e + 1) in whole:  # an epoch ends before the next one begins
            assert len(ids) == sources.count(s)


def test_mixing_realises_the_order_by_definition(spark):
    """Every reading, its block, epoch and place against a plain walk through the permutations."""
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(i, " ".join(prose(i, r.randrange(0, 30))), "en", r.choice(["a", "a", "a", "a", "b", None]), 0) for i in range(200)]
    rows += [rows[5], rows[6], rows[6]]  # repeated rows
    df, seed, blocks = spark.createDataFrame(rows, DOCS), 17, 12
    plan = {p["source"]: p for p in mixing.plan(df, entropy=0.98).collect()}
    total = sum(p["tokens"] for p in plan.values())
    keyed = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n"), mixing._key(seed).alias("h"))
    hashes = lambda values, kinds: [x[0] for x in spark.createDataFrame(values, kinds).select(F.xxhash64("*")).collect()] if values else []
    want = []
    for s, p in plan.items():
        own = [x for x in keyed.collect() if x["source"] == s]
        n_blocks = math.ceil(p["tokens"] / total * blocks)
        block = [h % n_blocks for h in hashes([(seed + 1, x["h"]) for x in own], "a int, b long")]
        at = epoch = 0
        while at < p["budget"]:
            used = sorted(set(block))
            order = hashes([(seed + 2, epoch, b, s) for b in used], "a int, b int, c long, d string")
            for _, b in sorted(zip(order, used)):
                if at >= p["budget"]:
                    break
                inside = [x for x, k in zip(own, block) if k == b]
                rank = hashes([(seed + 3, epoch, x["h"]) for x in inside], "a int, b int, c long")
                to, last = at, None
                for o, x in sorted(zip(rank, inside), key=lambda y: (y[0], y[1]["h"])):
                    if to < p["budget"] or last == x["h"]:
                        want.append((x["doc_id"], s, x["n"], epoch, b, round(at / p["budget"], 9), o))
                        last = x["h"]
                    to += x["n"]
                at += sum(x["n"] for x in inside)
            epoch += 1
    got = [(x["doc_id"], x["source"], x["n_tokens"], x["epoch"], x["block"], round(x["mix_pos"], 9), x["order_in_block"]) for x in mixing.readings(df, entropy=0.98, blocks=blocks).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({x[3] for x in got}) > 1


def test_mixing_edges(spark, odd):
    assert mixing.readings(empty(spark)).count() == 0
    assert set(mixing.resample(odd).columns) == set(odd.columns)
    one = spark.createDataFrame([(1, "a b", "en", None, 3), (1, "a b", "en", None, 3)], DOCS)
    assert mixing.readings(one).count() == 2


# 2: fingerprints


def test_fingerprint_peeling_recovers_differences():
    a = [" ".join(prose(i, 9)) + "." for i in range(60)]
    b = a[:20] + ["something else entirely here."] + a[25:] + a[:2]
    (ka, na), (kb, nb) = fingerprint.keys([" ".join(a)]), fingerprint.keys([" ".join(b)])
    only_a, only_b, m = fingerprint.recover(ka, kb)
    assert only_a == set(map(int, ka)) - set(map(int, kb)) and only_b == set(map(int, kb)) - set(map(int, ka))
    near, took = fingerprint.likeness(ka, na, kb, nb)
    d = len(only_a) + len(only_b)
    assert near[0] == (na[0] + nb[0] - d) / (na[0] + nb[0] + d) and took[0] == m
    far, took = fingerprint.likeness(ka, na, *fingerprint.keys([" ".join(prose(99, 3000))]))
    assert far[0] < 0.05 and took[0] > fingerprint.CELLS  # it had to retry larger


def test_fingerprints_of_documents(spark, odd):
    rows = odd.orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(odd).collect()}
    assert len(got) == len(rows)
    for i, x in enumerate(rows):
        text, nxt = x["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + nxt[:k]
        r = got[x["doc_id"]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[3]["fingerprint"] == got[4]["fingerprint"] and got[3]["near_next"] == 1
    assert got[5]["near_next"] > 0.95 and got[5]["near_edited"] > 0.5
    assert fingerprint.fingerprints(empty(spark)).count() == 0
    single = docs_of(spark, ["alone by itself"])
    assert fingerprint.fingerprints(single).first()["near_next"] == 1


# 3: WARC


def test_warc_round_trip(spark, tmp_path):
    big, html = "x" * 1000, "é<p>" * 400
    rows = [(1, "u1", html), (2, "u2", html), (3, None, None), (4, "u4", ""), (5, "u5", "small"), (6, "u6", "small"), (7, "u7", big), (9, "u9", html), (10, "a\r\nb", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        payload = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "")]
        keeper = max(same) if len(payload) >= 1000 else i
        assert got[i]["payload_bytes"] == len(payload) and got[i]["payload_digest"] == hashlib.sha1(payload).hexdigest()
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if keeper == i else ("revisit", keeper))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_filters_splits_and_plain_files(spark, tmp_path):
    path = str(tmp_path / "w")
    pages = spark.createDataFrame([(i, f"http://h/{i % 5}/", "z" * (i * 37 % 2500)) for i in range(200)], "page_id long, url string, html string")
    warc.archive(pages.coalesce(1), path)
    (tmp_path / "w" / "more.warc").write_bytes(b"".join(warc.record(f"urn:page:{i}", "response", "http://plain/", None, None, None, b"p" * i) for i in (1000, 1001)))
    (tmp_path / "w" / "empty.warc.gz").write_bytes(b"")
    df = warc.load(spark, path)
    whole = df.count()
    assert whole == 202
    small = spark.read.format("warc").option("path", path).option("split", "700").load()
    assert small.count() == whole and small.rdd.getNumPartitions() > 10
    assert {r["record_id"] for r in small.collect()} == {r["record_id"] for r in df.collect()}
    picked = df.where("record_type = 'response' and target_uri like 'http://h/3%' and content_length > 500")
    assert {r["record_id"] for r in picked.collect()} == {r["record_id"] for r in df.collect() if r["record_type"] == "response" and r["target_uri"].startswith("http://h/3") and r["content_length"] > 500}
    assert warc.load(spark, path, payload=False).where("payload is not null").count() == 0
    assert df.where("target_uri = 'http://plain/'").agg({"payload_length": "max"}).first()[0] == 1001


def test_warc_skips_payloads_it_need_not_decode():
    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            self.got += len(out)
            return out

    noise = np.random.default_rng(1).integers(0, 256, 3 << 20, dtype=np.uint8).tobytes()
    data = b"".join(warc.member(warc.record(f"urn:page:{i}", "response", "u", None, None, None, noise)) for i in range(4))
    source = Counted(data)
    assert len(list(warc.records(source, 0, len(data), [warc.Test("record_type", "=", "revisit")], True))) == 0
    assert source.got < len(data) // 2


# 4: decontamination

ITEMS = [(1, "Which river runs past the silver garden in winter? " + " ".join(prose(70, 14)) + ". The violet harbor answers."), (2, " ".join(prose(71, 40)) + ".\n" + " ".join(prose(72, 8))), (3, None), (4, "tiny item"), (5, "")]


def brute_leaks(texts, items, threshold=0.6, overlap=0.6, n=5):
    known = [(i, t) for i, t in items if decontam.words(t)]
    tokens = [decontam.words(t) for _, t in known]
    df = collections.Counter(w for t in tokens for w in set(t))
    mean = sum(map(len, tokens)) / len(tokens)
    stride = max(decontam.MIN_STRIDE, max(map(len, tokens)))
    out = set()
    for d, text in enumerate(texts):
        w = decontam.words(text)
        for s in range(0, max(len(w), 1), stride):
            p = w[s : s + 2 * stride]
            for (i, t), own in zip(known, tokens):
                norm = decontam.K1 * (1 - decontam.B + decontam.B * len(own) / mean)
                score = {x: math.log1p((len(known) - df[x] + 0.5) / (df[x] + 0.5)) * c * (decontam.K1 + 1) / (c + norm) for x, c in collections.Counter(own).items()}
                if sum(v for x, v in score.items() if x in set(p)) < threshold * sum(score.values()) - 1e-9:
                    continue
                q, a = decontam.split_item(t)
                share = lambda g: 1.0 if not g else len([x for x in g if x in decontam.ngrams(p, len(x)) and len(p) >= len(x)]) / len(g)
                if len(own) < n and share({tuple(own)}) < 1:
                    continue
                if share(decontam.ngrams(q, n)) >= overlap and share(decontam.ngrams(a, n)) >= overlap:
                    out.add((d, i))
    return out


def test_decontamination_equals_brute_force(spark):
    more = ITEMS + [(10 + i, " ".join(prose(200 + i, 20 + i)) + ". " + " ".join(prose(300 + i, 6))) for i in range(30)]
    texts = []
    for i in range(60):
        w = prose(i + 1000, 150 + 5 * i)
        if i % 3 == 0:
            w[i : i] = more[i % len(more)][1].split() if more[i % len(more)][1] else []
        if i % 7 == 0:
            w[100:100] = more[(i + 5) % len(more)][1].upper().split()[:-2] if more[(i + 5) % len(more)][1] else []
        texts.append(" ".join(w))
    texts += [None, "", "a tiny item!", "tiny, item", "item tiny"]
    docs = docs_of(spark, texts)
    items = spark.createDataFrame(more, "item_id long, text string")
    want = brute_leaks(texts, more)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()} == want and len(want) > 15
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items, shard_bytes=900).collect()} == want
    left = {r["doc_id"] for r in decontam.clean(docs, items).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}
    assert decontam.clean(docs, items).columns == docs.columns


def test_decontamination_edges(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(odd, none).count() == 0 and decontam.clean(odd, none).count() == odd.count()
    assert decontam.leaks(empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# 5: language ID


def test_language_id(spark):
    rows = []
    for i in range(200):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(prose(i, 12, STYLES[lang])), lang, "s", 0))
    rows += [(200, None, "en", "s", 0), (201, "", "en", "s", 0), (202, "123 !?", None, "s", 0), (203, "the winter river and the stone", None, "s", 0)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] and 0.5 < got[r[0]]["score"] <= 1 for r in rows[:200])
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0) for i in (200, 201, 202))
    assert got[203]["lang_pred"] == "en"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    kept = langid.keep_known(spark.createDataFrame(rows, DOCS))
    assert {r["doc_id"] for r in kept.collect()} == set(range(200)) | {203} and kept.columns == DOCS.replace(",", "").split()[::2]


def test_language_id_scores_as_the_formula():
    rng = np.random.default_rng(3)
    m = langid.Model(["a", "b"], rng.integers(0, 50, (2, langid.BUCKETS)), np.array([3, 1]))
    text = "Grüße, aus  Köln! 42"
    points = langid.normalise(text)
    assert "".join(map(chr, points)) == " grüße aus köln "
    want = m.prior.copy()
    for n in langid.ORDERS:
        for i in range(points.size - n + 1):
            h = np.zeros(1, np.uint32)
            for c in points[i : i + n]:
                h = (h ^ c) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            if not (n == 1 and points[i] == 32):
                want += m.matrix[int((h * np.uint32(0x85EBCA6B))[0] >> np.uint32(16))]
    langs, scores = m.predict(["x", text, None])
    assert langs[1] == "ab"[want.argmax()] and abs(scores[1] - 1 / np.exp(want - want.max()).sum()) < 1e-9


def test_language_id_edges(spark, odd):
    assert langid.identify(empty(spark)).count() == 0
    assert langid.identify(odd).count() == odd.count()
    none = docs_of(spark, ["abc"]).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert langid.identify(none).first()["lang_pred"] == "und"


# 6: near-duplicates


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_words_are_those_of_python():
    texts = ["A b\tC\n d", None, "", " \u3000x\xa0Y\x1cz ", "É é e\u0301", "a" * 5000 + " " + "a" * 4999, "\x00 \x00\x00"]
    name, n = hashed_words(texts)
    words = [(t or "").lower().split() for t in texts]
    assert n.tolist() == list(map(len, words))
    flat = [w for own in words for w in own]
    assert len(dict(zip(name.tolist(), flat))) == len(dict(zip(flat, name.tolist()))) == len(set(flat))


def test_histograms_bound_edits():
    r = random.Random(6)
    for n in (10, 300, 3000):
        a = [f"w{r.randrange(n)}" for _ in range(n)]
        b = a[: n - n // 7] + [f"v{r.randrange(n)}" for _ in range(n // 9)]
        x, y = neardup.histograms(*hashed_words([" ".join(a), " ".join(b), ""]))
        assert 0 < neardup.least_edits(x, y) == neardup.least_edits(y, x) <= n // 7


def test_banded_distance():
    r = random.Random(1)
    for _ in range(800):
        a = [r.randrange(r.choice([2, 4, 20])) for _ in range(r.randrange(14))]
        b = a[:]
        for _ in range(r.randrange(5)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = [r.randrange(4)] * r.randrange(3)
        want = levenshtein(a, b)
        for limit in (0, 1, 2, 3, 20):
            assert neardup.distance(np.array(a, np.uint64), np.array(b, np.uint64), limit) == min(want, limit + 1)


def test_order_min_hash_follows_its_definition():
    text = " ".join(prose(4, 60) + prose(4, 60))
    name, n = hashed_words([text, "two words", "w"])
    h, count = neardup.shingles(name, n)
    assert count.tolist() == [116, 1, 1] and len(set(h[:116].tolist())) == 116  # repeated shingles are told apart by number
    s = neardup.minima(h, count)
    moved = " ".join((prose(4, 60) + prose(4, 60))[60:] + ["x"] + (prose(4, 60) + prose(4, 60))[:60])
    g, m = neardup.shingles(*hashed_words([moved]))
    assert 0 < (s[0] == neardup.minima(g, m)[0]).mean() < 1
    own = neardup.sketch(name, n)
    assert set(own[0].tolist()) == set(s[0].view(np.int64).tolist()) and own[1].size == own[2].size == 1
    assert (neardup.sketch(*hashed_words([text]))[0] == own[0]).all()


def test_turned_minima_follow_their_definition():
    """The two shingles after each point of the circle of hashes, in text order; texts near the border take both kinds."""
    texts = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((150, 260, 900))]
    name, n = hashed_words(texts)
    h, count = neardup.shingles(name, n)
    got = neardup.turned(h, count)
    first = np.cumsum(count) - count
    for i in range(3):
        own = h[first[i] : first[i] + count[i]]
        order = sorted(range(own.size), key=lambda j: own[j])
        for t in (0, 1, 63, 127):
            point = t << 57
            after = [j for j in order if own[j] >= point] + [j for j in order if own[j] < point]
            assert got[i, t] == neardup._tuples(own, np.array(sorted(after[:2]))[:, None])[0]
    sizes = [x.size for x in neardup.sketch(name, n)]
    assert sizes[0] <= 128 < sizes[1] and sizes[2] <= 128
    w = texts[2].split()
    w[450:500] = [f"v{k}" for k in range(50)]
    a, b = neardup.sketch(*hashed_words([texts[2], " ".join(w)]))
    assert 0.6 < np.intersect1d(a, b).size / a.size < 1


def test_near_duplicate_groups(spark):
    r = random.Random(2)
    base = [prose(i, 80 + i) for i in range(40)]
    texts = [" ".join(w) for w in base]
    for i in range(0, 40, 2):
        for _ in range(3):
            w = base[i][:]
            for _ in range(len(w) // 20):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    hot = prose(500, 100)
    for j in range(150):  # a large group of near copies, each different
        w = hot[:]
        w[r.randrange(100)] = f"v{j}"
        texts.append(" ".join(w))
    texts += [texts[1]] * 60 + [None, None, "", "  "]
    shared = prose(900, 60)  # dissimilar documents around one passage
    texts += [" ".join(prose(2000 + j, 100) + shared) for j in range(30)]
    docs = docs_of(spark, texts)
    got = {x["doc_id"]: x for x in neardup.group(docs).collect()}
    assert len(got) == len(texts)
    w = [hashed_words([t])[0] for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, t in enumerate(texts):
        if w[i].size:
            parent[i] = first.setdefault(t, i)
    for i in sorted(first.values()):
        for j in sorted(first.values()):
            if i < j and min(w[i].size, w[j].size) >= 0.8 * max(w[i].size, w[j].size) and find(i) != find(j) and neardup.near(w[i], w[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: got[i]["class_id"] for i in got} == {i: find(i) for i in range(len(texts))}
    kept = {x["doc_id"] for x in neardup.keep_one(docs).collect()}
    assert kept == {i for i in range(len(texts)) if find(i) == i}
    size = collections.Counter(find(i) for i in range(len(texts)))
    assert all(got[i]["class_docs"] == size[find(i)] for i in got)


def test_near_duplicates_down_to_the_threshold(spark):
    """Scattered edits at similarity 0.85 and 0.9 are found, and short texts with one or two edits."""
    r = random.Random(12)
    texts = []
    for i in range(60):
        w = [f"w{i}x{r.randrange(500)}" for _ in range(100)]
        texts.append(" ".join(w))
        for k in r.sample(range(100), 10 if i % 2 else 15):
            w[k] = f"v{i}x{k}"
        texts.append(" ".join(w))
    for i, n in enumerate((5, 6, 7, 8, 9, 10, 11, 12, 13, 14)):
        w = [f"s{i}x{k}" for k in range(n)]
        texts.append(" ".join(w))
        w[n // 2] = "changed"
        if n >= 10:
            w.pop(n // 4)
        texts.append(" ".join(w))
    got = {x["doc_id"]: x["class_id"] for x in neardup.group(docs_of(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_large_groups_of_unlike_texts_stay_apart(spark):
    """Texts around one passage, near copies among them, and chains whose ends are not near: as brute force finds them."""
    r = random.Random(31)
    words = [f"g{k}" for k in range(4000)]
    shared = [r.choice(words) for _ in range(70)]
    texts = []
    for j in range(260):
        own = [r.choice(words) for _ in range(60)]
        texts.append(own + shared)
        if j % 5 == 0:  # a near copy, off by a tenth, all of it outside the passage
            w = own[:]
            for k in r.sample(range(60), 13):
                w[k] = r.choice(words)
            texts.append(w + shared)
    chain = [r.choice(words) for _ in range(50)]
    for j in range(12):
        chain = chain[:]
        for k in r.sample(range(50), 8):
            chain[k] = r.choice(words)
        texts.append(chain + shared[:40])
    got = {x["doc_id"]: x["class_id"] for x in neardup.group(docs_of(spark, [" ".join(w) for w in texts])).collect()}
    w = [hashed_words([" ".join(t)])[0] for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(w)):
        for j in range(i):
            if find(i) != find(j) and neardup.near(w[i], w[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in range(len(w))}


def test_prefixes_lose_no_near_pair(spark):
    """With groups larger than OUTSIDE at each level, the prefix join alone finds what brute force finds."""
    r = random.Random(8)
    words = [f"g{k}" for k in range(60)]
    texts = [[r.choice(words) for _ in range(r.randrange(1, 30))] for _ in range(150)]
    for i in range(100):
        w = texts[i][:]
        for _ in range(len(w) // 6):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(w)
    texts = [list(t) for t in {tuple(t) for t in texts}]
    w = [hashed_words([" ".join(t)])[0] for t in texts]
    rows = spark.createDataFrame([(0, i, i, len(t), " ".join(t)) for i, t in enumerate(texts)], "key long, node long, root long, size int, text string")
    before, neardup.OUTSIDE = neardup.OUTSIDE, 3
    try:
        asked = []

        def compared(pairs):
            got = [(x["a"], x["b"]) for x in pairs.collect()]
            asked.append(len(got))
            return spark.createDataFrame([p for p in got if neardup.near(w[p[0]], w[p[1]])], "a long, b long")

        none = spark.createDataFrame([], "a long, b long")
        links, root = neardup.resolve(rows, rows.select("node", "text"), none, none.toDF("node", "root"), compared)
    finally:
        neardup.OUTSIDE = before
    got = {x["node"]: x["root"] for x in root.collect()}
    assert len(asked) == 4 and asked[-1]
    near = [(i, j) for i in range(len(w)) for j in range(i) if neardup.near(w[i], w[j])]
    assert near and all(got.get(i, i) == got.get(j, j) for i, j in near)
    assert all(neardup.near(w[x["a"]], w[x["b"]]) for x in links.collect())


def test_links_are_called_those_of_pivots(spark):
    """Six mutually near texts have five links each; pairs already in one component aren't compared, and the column says so."""
    w = prose(40, 100)
    texts = [" ".join(w[: 10 * i] + [f"v{i}"] + w[10 * i + 1 :]) for i in range(6)]
    got = neardup.group(docs_of(spark, texts))
    assert got.columns == ["doc_id", "class_id", "class_docs", "class_texts", "n_pivot_links"]
    assert all(1 <= x["n_pivot_links"] <= 5 for x in got.collect())


def test_pairs_are_compared_once_and_not_within_a_component(spark, monkeypatch):
    """Near copies meet several pivots and unlike texts around a passage several words; neither is compared anew for each."""
    r = random.Random(17)
    hot, shared = prose(77, 120), prose(78, 60)
    texts = []
    for j in range(120):
        w = hot[:]
        for k in r.sample(range(120), 6):
            w[k] = f"v{j}x{k}"
        texts.append(" ".join(w))
    texts += [" ".join(prose(3000 + j, 60) + shared) for j in range(100)]
    asked, possible = [], neardup.possible

    def counted(pairs, nodes):
        asked.append([(x["a"], x["b"]) for x in pairs.collect()])
        return possible(pairs, nodes)

    monkeypatch.setattr(neardup, "possible", counted)
    monkeypatch.setattr(neardup, "OUTSIDE", 8)
    got = {x["doc_id"]: x["class_id"] for x in neardup.group(docs_of(spark, texts)).collect()}
    assert got == {i: 0 if i < 120 else i for i in range(220)}
    pairs = [p for some in asked for p in some]
    assert len(pairs) == len(set(pairs)) and any(a >= 120 for a, _ in pairs)
    assert sum(b < 120 for _, b in pairs) <= 1.5 * 120


def test_slices_bound_what_is_shuffled_and_lose_no_pair(spark, monkeypatch):
    """Members of large groups go through in slices; the same pairs are compared as at once, none of them twice."""
    r = random.Random(23)
    shared = prose(91, 30)
    texts = [" ".join(prose(5000 + j, 30) + shared) for j in range(24)]
    rows = spark.createDataFrame([(0, i, i, 60, t) for i, t in enumerate(texts)], "key long, node long, root long, size int, text string")
    none = spark.createDataFrame([], "a long, b long")
    met, groups_of = [], neardup.groups_of

    def grouped(members):
        met.append(members.count())
        return groups_of(members)

    def pairs_of(most):
        asked = []
        met.clear()
        monkeypatch.setattr(neardup, "ROWS", most)

        def compared(pairs):
            asked.extend((x["a"], x["b"]) for x in pairs.collect())
            return none

        neardup.resolve(rows, rows.select("node", "text"), none, none.toDF("node", "root"), compared)
        assert len(asked) == len(set(asked))
        return set(asked), list(met)

    monkeypatch.setattr(neardup, "OUTSIDE", 8)
    monkeypatch.setattr(neardup, "groups_of", grouped)
    whole, at_once = pairs_of(1 << 22)
    some, in_slices = pairs_of(max(at_once) // 3)
    assert whole == some and max(in_slices) <= 2 * max(at_once) // 3 < max(at_once)
    parts = neardup.sliced(rows, 60 * 6, ["node"], neardup.F.col("size"))
    assert len(parts) == 4 and sorted(x["node"] for p in parts for x in p.collect()) == list(range(24))


def test_near_duplicates_edges(spark, odd):
    assert neardup.group(empty(spark)).count() == 0 and neardup.keep_one(empty(spark)).count() == 0
    got = {r["doc_id"]: r["class_id"] for r in neardup.group(odd).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    assert neardup.keep_one(odd).columns == odd.columns
    twice = odd.unionByName(odd)
    assert sorted(r["doc_id"] for r in neardup.keep_one(twice).where("doc_id > 2").collect()) == [3, 5, 7]
    assert neardup.group(twice).count() == 16


# 8: quality


def test_quality_learns_and_scores(spark):
    good = [" ".join(prose(i, 60)) + "." for i in range(120)]
    bad = [" ".join(x + "!!" for x in prose(i + 500, 60)).upper() for i in range(120)]
    docs = docs_of(spark, good + bad + [None, "", "é" * 40000])
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 243 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in range(240))
    assert sum((got[i]["score"] >= 0.5) == (i < 120) for i in held) >= 0.95 * len(held)


def test_quality_scores_in_batches_as_alone():
    net = quality.Network(3)
    texts = ["short", "", None, "middling " * 40, "long text with é " * 9000, "x" * 511, "y" * 512, "z" * 513, "odd" * 85]
    alone = np.array([net.logit(t) for t in texts])
    assert np.allclose(net.logits(texts), alone, atol=1e-4) and np.allclose(net.logits(texts[::-1])[::-1], alone, atol=1e-4)
    # by definition: the mean over chunks of the linear layer on each chunk's maxima
    data = np.frombuffer(quality.as_bytes(texts[3]), np.uint8)
    at = range(0, len(data) - quality.WIDTH + 1, quality.STEP)
    y = np.maximum(np.stack([net.embed[data[i : i + quality.WIDTH]].reshape(-1) @ net.conv + net.bias for i in at]), 0)
    starts = range(0, max(1, len(y) - quality.HALF), quality.HALF)
    want = np.mean([y[s : s + 2 * quality.HALF].max(axis=0) @ net.out + net.shift[0] for s in starts])
    assert abs(net.logit(texts[3]) - want) < 1e-4


def test_quality_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(odd, none).collect()} == {0.5}
    assert quality.classify(empty(spark), none).count() == 0


# 9: substrings


def brute_cut(texts):
    words = [(t or "").encode().split() for t in texts]
    low = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 12):
            low.setdefault(tuple(w[p : p + 13]), i)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for p in range(len(w) - 12):
            if low[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def test_substring_dedup_equals_brute_force(spark):
    r = random.Random(8)
    texts = [None, "", "a " * 400, "a " * 13, "a " * 12, "b a " * 100, " ".join(["a"] * 20 + ["c"] * 20 + ["a"] * 7), "a b c " * 60]
    pool = [prose(i, 60, VOCAB[:6]) for i in range(8)]
    for i in range(120):
        w = prose(3000 + i, r.randrange(150), VOCAB[: r.choice([1, 2, 4, 30])])
        for _ in range(r.randrange(4)):
            p = pool[r.randrange(8)]
            a = r.randrange(40)
            at = r.randrange(len(w) + 1)
            w[at:at] = p[a : a + r.randrange(10, 25)]
        texts.append(" ".join(w) if i % 9 else " \t".join(w) + "\n")
    texts += texts[20:30] + ["x y " * 30, "x y " * 30]
    docs = docs_of(spark, texts)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring.dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cut(texts)


def test_contexts_that_agree_in_32_bits_are_no_repeat(spark):
    tail = "of and amber basil cedar delta ember fjord gable heron river stone cloud winter garden paper window silver morning letter bridge forest shadow"
    tail += " ivory jolly koala lemon mango noble ocean pearl quilt raven solar"
    pairs = [(62932, 72301), (55045, 81102), (42458, 153427), (70444, 158335)]  # these met in the upper half of a 64-bit context
    for pair in pairs:
        texts = [f"x{i} {tail}" for i in pair]
        got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring.dedup(docs_of(spark, texts)).collect()}
        assert [got[i] for i in range(2)] == brute_cut(texts)


def test_recompression_is_locally_consistent():
    r = np.random.default_rng(5)
    part = r.integers(0, 5, 40).astype(np.uint64)
    seen = []
    for _ in range(30):
        left, right = (r.integers(0, 5, r.integers(0, 30)).astype(np.uint64) for _ in range(2))
        name = np.concatenate((left, part, right))
        start, symbol, lo, hi = substring.recompress(name, np.zeros(name.size, np.int64))
        at = left.size
        seen.append({(int(s) - at, int(x), int(a) - at, int(b) - at) for s, x, a, b in zip(start, symbol, lo, hi) if a >= at and b <= at + 40})
    assert len(seen[0]) > 5
    for s in seen:  # a symbol whose reach lies inside the common part stands in all texts
        assert s == seen[0]


def test_substring_edges(spark, odd):
    assert substring.dedup(empty(spark)).count() == 0
    got = {r["doc_id"]: r for r in substring.dedup(odd).collect()}
    assert got[0]["n_words"] == 0 and got[0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[6]["n_removed"] == 9000 and got[5]["n_removed"] == 0
    twice = odd.unionByName(odd)
    assert sorted(r["n_removed"] for r in substring.dedup(twice).collect()) == [0] * 14 + [9000] * 2
    kept = {r["doc_id"]: r["kept_text"] for r in substring.dedup(odd, texts=True).collect()}
    assert kept[6] == "end"


# 10: token files


ODD_TEXTS = [" ".join(prose(i, 50)) for i in range(5)] + [None, "", " ", "It'S DON'T we'll 12 ÀÉß×÷ x{}[]_~ $$$ÿ1 \"İSTANBUL\" ﬁ Ångström ½ ª", "a<|endoftext|>b <|startoftext|>", "é Ä Σ ΑΣ. \x1c\x1d a\x85b　c​", "日本語 テスト 한국어 🙂 👩‍🔬", "a" * 300, "'s''ll", "The quick  brown fox\n\njumps it's", "a \u0301b\u0301 \u0301", "\ttabs\x0b \u2028 end "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    """Every tokenizer file of the library, on odd texts and on the driver's own, against encoding each whole text."""
    texts = ODD_TEXTS[:]
    if os.path.isdir("/root/testdata/sf0.001"):
        import duckdb

        texts += [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    e, t = tokenbin.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    assert e.by_token == (name == "word_bpe_49k.json")  # byte-level ids depend on the space before a word
    for most in (64 << 20, 1):
        e.most = most
        ids, sizes = e.encode(texts, 2)
        at = 0
        for text, n in zip(texts, sizes):
            assert ids[at : at + n].tolist() == t.encode(text or "", add_special_tokens=False).ids + [2], text
            at += n


def test_encoder_takes_whole_texts_unless_space_parts_them():
    t = Tokenizer.from_file(TOKENIZER)
    assert tokenbin.parts_at_space(t)
    import json

    for change in ({"post_processor": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}]}}, {"normalizer": None}):
        assert not tokenbin.parts_at_space(Tokenizer.from_str(json.dumps(json.loads(t.to_str()) | change)))


def test_blocks_round_trip():
    r = np.random.default_rng(2)
    for ids in (np.empty(0, np.uint32), np.array([7], np.uint32), r.integers(0, 50000, 5000).astype(np.uint32), np.full(3000, 9, np.uint32), np.where(r.random(9000) < 0.01, 2**32 - 1, r.integers(5, 9, 9000)).astype(np.uint32)):
        blocks = list(tokenbin.pack(ids))
        starts = np.cumsum([0] + [len(b) for b in blocks])[:-1]
        assert (tokenbin.unpack(b"".join(blocks), starts) == ids).all() if ids.size else not blocks


def test_file_reads_any_run():
    sink = pa.BufferOutputStream()
    w = tokenbin.Writer(sink)
    r = np.random.default_rng(4)
    sizes = r.integers(1, 700, 40)
    ids = r.integers(0, 49000, sizes.sum()).astype(np.uint32)
    cut = sizes[:15].sum()
    w.add(np.arange(15), np.zeros(15), ids[:cut], sizes[:15])
    w.add(np.arange(15, 40), np.zeros(25), ids[cut:], sizes[15:])
    assert w.close() == (40, ids.size)
    reader = tokenbin.Reader(pa.BufferReader(sink.getvalue()))
    assert (reader.ids(0, ids.size) == ids).all() and (reader.ids(1500, 3100) == ids[1500:3100]).all()
    assert [x.tolist() for _, x in reader.documents(900)] == [ids[a:b].tolist() for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))]


def test_token_files_of_documents(spark, odd):
    t = Tokenizer.from_file(TOKENIZER)
    start = 0
    got = {r["doc_id"]: r for r in tokenbin.encode(odd, TOKENIZER).collect()}
    for r in odd.orderBy("doc_id").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        x = got[r["doc_id"]]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenbin.encode(empty(spark), TOKENIZER).count() == 0
    more = spark.createDataFrame([(None, "x"), (3, "b"), (3, "a"), (3, "a"), (-5, "c")], "doc_id long, text string")
    rows = tokenbin.encode(more, TOKENIZER).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, -5, 3, 3, 3]


def test_range_parts_are_ascending(spark):
    df = spark.createDataFrame([(i * 7 % 1000 - 300,) for i in range(1000)] + [(None,)], "k long")
    rows = range_parts(df, "k", 6, "part").collect()
    top = {}
    for k, p in rows:
        top.setdefault(p, []).append(k)
    assert None in top[0]
    sure = {p: [k for k in v if k is not None] for p, v in top.items()}
    assert len(sure) == 6 and all(max(sure[p]) < min(sure[p + 1]) for p in range(5))


# the pipeline


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    texts = [" ".join(prose(i, 90)) for i in range(40)]
    texts += [texts[3], texts[4] + " more", None, "!!! 42"]
    item = "which lantern stands over the copper bridge at night? the violet one near the old orchard compass marble feather."
    texts.append(" ".join(prose(77, 40)) + " " + item + " " + " ".join(prose(78, 40)))
    docs_of(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["langid", "neardup", "decontam", "mixing", "tokenbin"]
    a = stages["langid"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in a.collect()} == set(range(42)) | {44}
    b = stages["neardup"](spark, a, str(tmp_path))
    assert {r["doc_id"] for r in b.collect()} == set(range(40)) | {44}
    c = stages["decontam"](spark, b, str(tmp_path))
    assert {r["doc_id"] for r in c.collect()} == set(range(40)) and c.columns == docs.columns
    d = stages["mixing"](spark, c, str(tmp_path))
    assert d.columns == docs.columns
    rows = sorted(d.collect(), key=lambda r: (r["doc_id"], r["text"]))
    t, start, want = Tokenizer.from_file(TOKENIZER), 0, []
    for r in rows:
        ids = t.encode(r["text"], add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)
