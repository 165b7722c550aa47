"""License scans against brute force over all windows."""

import random

from locusloom.llm import licenses
from locusloom.llm.decontam import words

DOCS = "doc_id long, text string"


def brute(texts, templates, containment=0.8):
    out = {}
    for i, text in enumerate(texts):
        w = words(text)
        for name, t in templates:
            tw = words(t)
            if not tw:
                continue
            k, n = min(5, len(tw)), len(tw)
            want = set(licenses.shingles(tw, k))
            for a in range(0, max(len(w), 1), n // 4 + 2):
                share = len(set(licenses.shingles(w[a : a + n + n // 4 + 1], k)) & want) / len(want)
                if share >= containment - 1e-9:
                    best = out.get((i, name), (0, 0))
                    out[i, name] = max(best, (share, -a))
    return {k: (v[0], -v[1]) for k, v in out.items()}


def test_scan_equals_brute_force(spark):
    r = random.Random(3)
    vocab = "the license under mit of work this is version river stone garden 2 0 by".split()
    texts = [None, "", "mit license", "!!!"]
    for i in range(150):
        w = [r.choice(vocab) for _ in range(r.randrange(120))]
        for _ in range(r.randrange(3)):
            t = r.choice(licenses.NOTICES)[1].split()
            if r.random() < 0.4:
                t[r.randrange(len(t))] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = t
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "1 as position", "'x' as license_id")
    got = {(x["doc_id"], x["license_id"]): (x["containment"], x["position"]) for x in licenses.scan(docs).collect()}
    assert got == brute(texts, licenses.NOTICES) and len(got) > 60


def test_scan_edges(spark):
    docs = spark.createDataFrame([(None, "two words here"), (1, "Two  WORDS!"), (1, "two words")], DOCS)
    own = spark.createDataFrame([("A", "two words"), ("B", None), ("C", "")], "license_id string, text string")
    got = sorted((x["doc_id"] is not None, x["license_id"], x["n_windows"]) for x in licenses.scan(docs, own).collect())
    assert [g[:2] for g in got] == [(False, "A"), (True, "A")]
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, own.limit(0)).count() == 0
