"""Filter interaction audit, periodic runs and toxicity."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.llm import filteraudit, periodicruns, toxicity
from tests.llm import data

LABELS = "doc_id long, quality int, toxic int, text string"


def labels_frame(spark, rows):
    return spark.createDataFrame([(d, q, t, "clash") for d, q, t in rows], LABELS)


# filter interaction audit

def test_posting_list_merges_are_set_operations():
    rnd = random.Random(3)
    for _ in range(2000):
        lists = [sorted(rnd.sample(range(rnd.choice([5, 60, 400])), rnd.randint(0, 5))) for _ in range(rnd.randint(0, 6))]
        lists += [list(range(a, a + rnd.randint(0, 70))) for a in rnd.sample(range(100), rnd.randint(0, 3))]
        assert filteraudit.union(lists) == sorted(set().union(*lists))
        for a in lists[:3]:
            for b in lists[-3:]:
                assert filteraudit.difference(a, b) == sorted(set(a) - set(b)) and filteraudit.shared(a, b) == len(set(a) & set(b))


def test_gallop_finds_the_first_not_below():
    rnd = random.Random(4)
    for _ in range(2000):
        x = sorted(rnd.sample(range(300), rnd.randint(1, 90)))
        begin, value = rnd.randrange(len(x)), rnd.randrange(310)
        want = next((i for i in range(begin, len(x)) if x[i] >= value), len(x))
        assert filteraudit.gallop(x, value, begin) == want


def brute_audit(docs, labels):
    """Filters walked in every order, row by row."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, *_ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    for d, t, g, _ in docs:
        t = t or ""
        words = t.encode().split()
        fails = {f for f, x in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in t for c in "#$%&*|"), d is not None and first[t] < d)) if x}
        rows.append((g or "", fails, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine),
                                                   sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_cases():
    rows = data.rows()
    for i in range(60):
        t = data.prose(200 + i % 9, 150 + 13 * (i % 9)).title() if i % 4 == 0 else data.prose(200 + i % 20, 120 + 17 * (i % 11))
        rows.append((100 + i, t + (" #" if i % 7 == 0 else ""), ("en", "fr", None)[i % 3], "s"))
    rows += [(90, None, "en", "s"), (90, None, "en", "s"), (5, "\n".join(data.lines(1, 8)), "xx", "s")]
    return rows


def test_audit_is_the_walk_in_every_order(spark):
    docs = audit_cases()
    labels = [(d, i % 2, int(i % 3 == 0)) for i, (d, *_) in enumerate(docs) if i % 4] + [(1, 1, 1), (1, 0, 0), (None, 1, 1), (2, None, None)]
    for partitions in (1, 7):
        got = filteraudit.audit_documents(data.frame(spark, docs).repartition(partitions), labels_frame(spark, labels))
        cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        rows = {(r.part, r.filter_order, r.step): tuple(r[c] for c in cols) for r in got.collect()}
        assert rows == brute_audit(docs, labels)
        assert len(rows) == 600 * 4


def test_audit_over_many_ranges(spark):
    """Batches of a few rows: ranges cut parts and repeated ids anywhere."""
    docs = audit_cases()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = filteraudit.audit_documents(data.frame(spark, docs), labels_frame(spark, []))
        rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert rows == {k: (v[0], v[1], v[6]) for k, v in brute_audit(docs, []).items()}


def test_audit_of_nothing(spark):
    assert filteraudit.audit_documents(data.frame(spark, []), labels_frame(spark, [])).count() == 0


# periodic runs

def brute_runs(w):
    """Every lag's stretches of equal words; of equal stretches the smallest lag."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            s = i
            while i < n and w[i] == w[i - q]:
                i += 1
            if i > s and i - s + q >= max(6, 4 * q):
                out.setdefault((s - q, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_are_those_of_all_lags():
    rnd = random.Random(1)
    for _ in range(1500):
        docs = []
        for _ in range(rnd.randint(1, 4)):
            n, k = rnd.randint(0, 90), rnd.choice([1, 2, 3, 8])
            w = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.7:
                a = rnd.randrange(n)
                p = 1 + (n - a) // rnd.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                for _ in range(rnd.randint(0, 2)):
                    w[rnd.randrange(n)] = 99
            docs.append(w)
        got = periodicruns.find_runs(np.array(sum(docs, []), np.int64), np.array([len(w) for w in docs]))
        want, at = [], 0
        for w in docs:
            want += [(s + at, n, q) for s, n, q in brute_runs(w)]
            at += len(w)
        assert list(zip(*[x.tolist() for x in got])) == want


def test_one_word_repeated_is_linear():
    start, length, period = periodicruns.find_runs(np.zeros(400_000, np.int64), np.array([400_000]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [400_000], [1])


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_digest_is_the_plain_form(spark):
    rows = data.rows() + [(1000 + i, data.prose(i % 30, 5 + i % 120), "en", "s") for i in range(300)]
    rows += [(5000 + i, " ".join(random.Random(i).choices("ab", k=90)), "en", "s") for i in range(60)]
    rows += [(6000, " x\x0bx x\r\nx x x  y", "en", "s"), (6001, "a\x1cb " * 7, "en", "s"), (-7, "z " * 30, "en", "s")]
    got = sorted(periodicruns.digest(data.frame(spark, rows).repartition(3)).collect(), key=str)
    want = []
    for d, t, *_ in rows:
        w = planted(d, (t or "").encode().split())
        runs = brute_runs(w) if len(w) < 5000 else []
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((d, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_runs_and_collapsed_text(spark):
    docs = spark.createDataFrame([("k", "go go go go go go home  now", 1)], "doc_id string, text string, runs int")
    row = periodicruns.periodic_runs(docs).collect()[0]
    assert row.doc_id == "k" and [tuple(r) for r in row.runs] == [(0, 6, 1)] and row.collapsed == "go home now"
    assert periodicruns.digest(data.frame(spark, [])).count() == 0


# toxicity

INSULTS = ["blorg", "snark", "grumf"]


def toxic_rows(n):
    """Every third text of prose holds insults; some texts are copies."""
    out, labels = [], []
    for i in range(n):
        t = data.prose(i // 2 if i % 20 == 19 else i, 40 + i % 30).split()
        bad = i % 3 == 0
        if bad:
            for k in range(3):
                t[(7 * k + i) % len(t)] = INSULTS[(i + k) % 3] + ("", "s", "ish,")[k]
        out.append((100 + i, " ".join(t), "en", "s"))
        labels.append((100 + i, 1, int(bad)))
    return out, labels


def brute_nearest(vectors, q, k, but=-1):
    terms, weights = q
    mine = dict(zip(terms.tolist(), weights.tolist()))
    cos = [(-round(sum(mine.get(t, 0) * w for t, w in zip(ts.tolist(), ws.tolist())), 9), i) for i, (ts, ws) in enumerate(vectors) if i != but]
    return [(i, -c) for c, i in sorted(cos) if c < 0][:k]


def test_block_max_search_is_exact():
    rnd = np.random.default_rng(5)
    for size, n_terms, k in ((1, 3, 4), (130, 30, 16), (1000, 60, 16), (700, 400, 5)):
        def vector():
            t = np.sort(rnd.choice(n_terms, rnd.integers(0, min(n_terms, 12)), replace=False))
            w = np.round(rnd.random(len(t)), 1) + 0.1
            return t, w / (np.linalg.norm(w) or 1)
        vectors = sorted((vector() for _ in range(size)), key=lambda v: v[0].tolist())
        index = toxicity.Index.build(vectors, n_terms)
        for _ in range(60):
            q = vector()
            but = int(rnd.integers(-1, size))
            found, cosines = index.nearest(*q, k, but)
            want = brute_nearest(vectors, q, k, but)
            assert found.tolist() == [i for i, _ in want] and cosines.tolist() == pytest.approx([c for _, c in want], abs=2e-9)


def test_isotonic_pools_neighbours():
    x, y = toxicity.isotonic(np.array([0.1, 0.4, 0.2, 0.3, 0.3, 0.9]), np.array([0, 1, 1, 0, 0, 1.0]))
    assert x.tolist() == [0.1, 0.2, 0.3, 0.4, 0.9] and y.tolist() == pytest.approx([0, 1 / 3, 1 / 3, 1, 1])


def test_scores_follow_the_text_alone(spark):
    rows, labels = toxic_rows(420)
    docs = data.frame(spark, rows + data.rows())
    model = toxicity.train(docs, labels_frame(spark, labels))
    held = {d for d, *_ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    assert not held & set(model.ids.tolist()) and len(model.ids) <= len(rows) - len(held)
    assert {w[:4] + "*" for w in INSULTS} <= set(model.idf) and max(model.idf.values()) <= math.log(len(model.ids) / toxicity.MIN_DOCS)
    other = data.frame(spark, rows).withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 100000)
    a = {r.doc_id: r for r in toxicity.score(data.frame(spark, rows), model).collect()}
    b = {r.doc_id - 100000: r for r in toxicity.score(other, model).collect()}
    assert all(a[d].score == b[d].score and a[d].evidence == b[d].evidence for d in a)
    true = {d: t for d, _, t in labels}
    # with some 350 examples a few clean texts have a chance stem's neighbours only
    clean = [d for d in held if not true[d]]
    assert all(a[d].predicted for d in held if true[d]) and sum(a[d].predicted for d in clean) <= 0.1 * len(clean)
    assert min(a[d].score for d in held if true[d]) >= max(a[d].score for d in clean) and all(0 <= r.score <= 1 for r in a.values())
    assert all(e.toxic == true[e.doc_id] for r in a.values() for e in r.evidence)
    toxic = [r for d, r in a.items() if true[d]]
    assert all(r.evidence and r.evidence[0].cosine >= r.evidence[-1].cosine > 0 for r in toxic)


def test_toxicity_edges(spark):
    rows, labels = toxic_rows(90)
    docs = data.frame(spark, rows + data.rows())
    got = toxicity.digest(docs, labels_frame(spark, labels + [(100, 1, 1), (None, 1, 1), (7, 1, None)]))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR predicted != int(score >= 0.5) OR held_out IS NULL").count() == 0
    # no label, one class only, no document
    assert {r.score for r in toxicity.digest(docs, labels_frame(spark, [])).collect()} == {0.0}
    assert {r.predicted for r in toxicity.digest(docs, labels_frame(spark, [(d, 1, 0) for d, *_ in labels])).collect()} == {0}
    assert toxicity.digest(data.frame(spark, []), labels_frame(spark, labels)).count() == 0


def test_examples_are_a_bounded_sample_of_different_texts(spark):
    rows, labels = toxic_rows(200)
    docs = data.frame(spark, rows + [(1000 + d, t, g, s) for d, t, g, s in rows])
    labels += [(1000 + d, q, 1 - t) for d, q, t in labels]
    got = toxicity.examples(docs, labels_frame(spark, labels), most=50).collect()
    assert len(got) == 50 == len({r.text for r in got}) and toxicity.examples(docs, labels_frame(spark, labels), most=50).count() == 50
    text = {d: t for d, t, *_ in rows}
    assert all(text[r.example % 1000] == r.text for r in got)
