"""Mixing, host reputation, the n-gram model and tool calls."""

import json
import math
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarmac.llm import hostrep, kneser, mixing, toolcalls
from tests.conftest import SF0001
from tests.llm import data


def words(t):
    return len((t or "").encode().split())


def fair_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Resharing in a loop. sizes: by source, in code-point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        rest -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_targets_are_the_loop(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 30, "d": 4, None: 70}, {"x": 5}, {"a": 0, "b": 0}, {f"s{i:02}": (i * 37) % 91 for i in range(25)}):
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        assert got == pytest.approx(fair_targets(sizes))


def test_mix_is_exact_and_reruns_agree(spark):
    rows = data.rows() + [(1000 + i, data.prose(i, 20 + i * 7 % 90), "en", f"s{i * i % 4}") for i in range(400)]
    docs = data.frame(spark, rows)
    plan = mixing.mix(docs, shards=8)
    got = plan.collect()
    assert Counter((r.id, r.source, r["size"]) for r in got) == Counter((d, s, words(t)) for d, t, _, s in rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += words(t)
    targets = fair_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.taken == r["size"] * len(r.draws) <= 2 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source]) and all(0 <= d.shard < 8 for d in r.draws)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(largest[s] / 2, 1) + 1
    again = mixing.mix(docs.repartition(7), shards=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = mixing.mixed_documents(docs, shards=8).groupBy("doc_id", "source").count().collect()
    want = Counter()
    for r in got:
        want[r.id, r.source] += len(r.draws)
    assert {(r.doc_id, r.source): r["count"] for r in copies} == {k: n for k, n in want.items() if n}


def test_mix_by_broadcast_and_by_shuffle_and_clashing_names(spark, monkeypatch):
    rows = [(i, data.prose(i, 20 + i * 7 % 90), "en", f"s{i * i % 4}") for i in range(200)]
    docs = data.frame(spark, rows).withColumns({c: F.lit("own") for c in ("draws", "words", "of", "number", "mix_draw", "mix_shard", "_mix_size")})
    got = mixing.digest(docs, shards=8)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, got.collect()))
    copies = mixing.mixed_documents(docs, shards=8).select("doc_id", "draws", "_mix_size", "mix_shard").collect()
    assert Counter((r.doc_id, r.mix_shard) for r in copies) == Counter((r[0], s) for r in got for s in r[5])
    assert all(r.draws == r._mix_size == "own" for r in copies) and len({r.mix_shard for r in copies}) > 1
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, mixing.digest(docs, shards=8).collect())) == got
    sizes = spark.createDataFrame([("a", 100), (None, 300)], "source string, source_size long")
    assert mixing._per_source(sizes, 1.5) == (False, mixing.SHARDS)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2)
    assert mixing._per_source(sizes, 1.5)[1] == 512


def test_tree_parts_sum_to_the_quotas(spark):
    quotas = spark.createDataFrame([(0, 4096), (1, 3), (2, 0), (3, 777)], "number int, quota long")
    parts = mixing.split_quotas(quotas, 16).collect()
    by_source, by_shard = Counter(), Counter()
    for r in parts:
        assert r.part >= 0
        by_source[r.number] += r.part
        by_shard[r.shard] += r.part
    assert [by_source[i] for i in range(4)] == [4096, 3, 0, 777]
    assert len(by_shard) == 16 and max(by_shard.values()) - min(by_shard.values()) <= 4


def test_hypergeometric_is_the_distribution(spark):
    n = 20000
    u = (F.col("id") + 0.5) / n
    got = spark.range(n).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(15), u).alias("k")).groupBy("k").count().collect()
    for r in got:
        p = math.comb(20, r.k) * math.comb(30, 15 - r.k) / math.comb(50, 15)
        assert abs(r["count"] / n - p) < 2e-4


def test_mix_of_nothing(spark):
    assert mixing.mix(data.frame(spark, []), shards=2).collect() == []
    assert mixing.mixed_documents(data.frame(spark, []), shards=2).collect() == []


URLS = [None, "no scheme", "http://", "HTTP://A.Example.NET/en/x?q#f", "http://example.net", "http://example.net/", "https://b.example.com/de/1",
        "https://notexample.com/de/1", "ftp://u:p@x.org:80/fr/z", "http://x.org/frz", "://?a", "http://host?x=/en/", "http://a.b/c#d/e", "http://a://b/c"]


def test_host_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([(0, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: tuple(r)[1:5] for r in hostrep.judge(pages, labels).collect()}
    assert got[0] == got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("example.net", "", None, "allow") and got[5] == ("example.net", "/", "net/", "block")
    assert got[6] == ("b.example.com", "/de/1", "example.com/de/", "block") and got[7][2] is None
    assert got[8][2] is None and got[8][0] == "u:p@x.org:80" and got[9][2] is None
    assert got[11] == ("host", "", None, "allow") and got[12] == ("a.b", "/c", None, "allow") and got[13] == ("a:", "//b/c", None, "allow")
    assert hostrep.judge(pages.limit(0), labels).collect() == []


def test_bad_hosts_are_blocked_and_equal_the_sql(spark):
    rows, labels = [], []
    for i in range(400):
        host = ["good.com", "bad.com", "sub.bad.com", "few.com"][i % 4] if i < 392 else "new.bad.com"
        rows.append((i, f"http://{host}/x"))
        if i % 4 != 3 or i < 8:
            labels.append((i, int(i % 4 not in (1, 2) or i % 40 == 1), int(i % 50 == 0)))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    known = spark.createDataFrame(labels[:-8] + labels[:3], "doc_id long, quality int, toxic int")
    got = hostrep.judge(pages, known)
    verdicts = {r.host: r.verdict for r in got.collect()}
    assert verdicts == {"good.com": "allow", "bad.com": "block", "sub.bad.com": "block", "few.com": "allow", "new.bad.com": verdicts["new.bad.com"]}
    con = duckdb.connect()
    con.register("p", pages.toPandas())
    con.register("l", known.toPandas())
    con.execute("CREATE VIEW pages AS FROM p; CREATE VIEW labels AS FROM l")
    res = con.execute(hostrep.ORACLE.replace("any_value", "any_value"))
    names = [d[0] for d in res.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(res.fetchall())


class BruteKneserNey:
    """The recursion on dicts of strings."""

    def __init__(self, texts):
        self.c = [None] * (kneser.ORDER + 1)
        top = Counter()
        for t in texts:
            s = [kneser.START] * (kneser.ORDER - 1) + [max(ord(x), 3) for x in t] + [kneser.END]
            top.update(tuple(s[i:i + kneser.ORDER]) for i in range(len(s) - kneser.ORDER + 1))
        self.c[kneser.ORDER] = top
        for n in range(kneser.ORDER - 1, 0, -1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.d = [None]
        self.context = [None]
        for n in range(1, kneser.ORDER + 1):
            k = Counter(self.c[n].values())
            y = k[1] / (k[1] + 2 * k[2]) if k[1] and k[2] else None
            self.d.append([min(max(i - (i + 1) * y * k[i + 1] / k[i], 0), i) if y and k[i] else 0.5 for i in (1, 2, 3)])
            ctx = defaultdict(lambda: [0, 0.0])
            for g, c in self.c[n].items():
                ctx[g[:-1]][0] += c
                ctx[g[:-1]][1] += self.d[n][min(c, 3) - 1]
            self.context.append(ctx)

    def p(self, g):
        if not g:
            return 1 / kneser.SYMBOLS
        n, low = len(g), self.p(g[1:])
        if g[:-1] not in self.context[n]:
            return low
        total, left = self.context[n][g[:-1]]
        c = self.c[n][g]
        return (max(c - self.d[n][min(c, 3) - 1], 0) + left * low) / total if c else left * low / total


def test_kneser_ney_is_the_recursion(spark):
    rows = [(i, data.prose(i, 25), "en", "s") for i in range(12)] + [(20, None, "en", "s"), (21, " ", None, None), (22, "Zq é", None, "s"), (None, "abc def", "en", "s")]
    trusted = [0, 1, 2, 3, 4, 5]
    frame = data.frame(spark, rows).select(F.col("doc_id").alias("id"), "lang", "text")
    got = kneser.score(frame, spark.createDataFrame([(i,) for i in trusted], "id long"), 3).collect()
    model = BruteKneserNey([kneser.normal(rows[i][1]) for i in trusted])
    assert len(got) == len(rows)
    by_id = {r.id: r for r in got}
    for d, t, *_ in rows:
        t = kneser.normal(t)
        s = [kneser.START] * (kneser.ORDER - 1) + [max(ord(x), 3) for x in t] + [kneser.END]
        at = [tuple(s[i:i + kneser.ORDER]) for i in range(len(s) - kneser.ORDER + 1)] if t else []
        assert by_id[d].n == len(at)
        assert by_id[d].bits == pytest.approx(sum(-math.log2(model.p(g)) for g in at), rel=1e-6)


def test_quality_classifier_keeps_clean_and_drops_junk(spark):
    docs, labels = (spark.read.parquet(f"{SF0001}/{t}.parquet") for t in ("documents", "labels"))
    got = kneser.classify(docs, labels, blocks=3).join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    assert sum(good) / len(good) > 0.97
    assert kneser.classify(data.frame(spark, []), labels).collect() == []
    none = kneser.classify(data.frame(spark), labels.limit(0)).collect()
    assert len(none) == len(data.rows()) and all(r.kept == bool(r.n_symbols) for r in none)


CALLS = [  # conv, turn, call_id, name, arguments
    (1, 1, "a", "note", '{"text": "x"}'), (1, 3, "b", "search", '{"query": "q", "limit": 3, "after": "a"}'),
    (1, 5, "c", "search", '{"limit": "3", "after": ["b", "a"], "more": 1}'), (1, 7, "a", "note", '{"text": "again"}'),
    (2, 1, "x", "search", '{"query": "q", "limit": 1, "after": "y"}'), (2, 2, "y", "search", '{"query": "q", "limit": 1, "after": "x"}'),
    (2, 3, "z", "search", '{"query": "q", "limit": 1, "after": "nowhere"}'), (2, 4, None, "note", '{"text": "n"}'), (3, 1, "a", "other", "[1, 2]"),
    (3, 2, "m", "note", '{"text": '), (3, 3, "n", None, None), (None, 1, "a", "note", '{"text": "x"}'), (3, 4, "o", "note", '{"b": 1, "text": {"z": 1, "a": [true, null]}}'),
]
RESULTS = [(1, 2, "a", 'say "hi"\n'), (1, 6, "a", "late"), (1, 4, "b", None), (3, 9, "q", "orphan"), (None, 9, None, "lost")]


def test_tool_calls(spark):
    calls = spark.createDataFrame(CALLS, "conv long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame(RESULTS, "conv long, turn long, call_id string, content string")
    got = {(r.conv, r.turn or r.result_turn, r.call_id): r for r in toolcalls.link(calls, results).collect()}
    assert len(got) == len(CALLS) + 2
    one = lambda *k: (got[k].status, got[k].level, got[k].errors)
    assert one(1, 1, "a") == ("linked", 0, []) and got[1, 1, "a"].result_turn == 2
    assert one(1, 3, "b") == ("linked", 1, [])
    assert one(1, 5, "c") == ("unanswered", 2, ["not STRING: after", "not BIGINT: limit", "missing query", "unknown more"])
    assert one(1, 7, "a")[0] == "duplicate" and one(2, 1, "x")[:2] == one(2, 2, "y")[:2] == ("cyclic", None)
    assert one(2, 3, "z") == ("unanswered", 0, ["unknown reference nowhere"]) and one(2, 4, None)[0] == "no identifier"
    assert one(3, 1, "a")[2] == ["not an object"] and one(3, 2, "m")[2] == one(3, 3, "n")[2] == ["malformed"]
    assert one(3, 9, "q")[0] == one(None, 9, None)[0] == "orphan result"
    assert got[1, 1, "a"].canonical == '{"arguments":{"text":"x"},"call_id":"a","name":"note","result":' + json.dumps(RESULTS[0][3]) + "}"
    assert json.loads(got[3, 4, "o"].canonical)["arguments"] == {"b": 1, "text": {"a": [True, None], "z": 1}}
    assert '"arguments":{"b":1,"text":{"a":[true,null],"z":1}}' in got[3, 4, "o"].canonical
    assert toolcalls.link(calls.limit(0), results.limit(0)).collect() == []
    assert {r.status for r in toolcalls.link(calls.limit(0), results).collect()} == {"orphan result"}


def test_pipeline_stages_against_brute_force(spark):
    from tests.llm.test_dedup import jaccard_components, line_brute
    docs = data.frame(spark, [r for r in data.rows() if r[0] != 14 or r[0] is None]).select("doc_id", "text", "lang", "source", "n_chars")
    names = docs.columns
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    first = corpus_pipeline.language_id(spark, docs, "")
    kept = [(r.doc_id, r.text, r.lang, r.source) for r in first.collect()]
    assert first.columns == names and {r[0] for r in kept} >= {1, 2, 3, 4, 5, 6, 13} and all(any(c.isalpha() for c in r[1]) and r[2] for r in kept)
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {7, 8, 9, 12}
    second = corpus_pipeline.line_dedup(spark, first, "")
    want = line_brute(kept)
    left = {r.doc_id: (r.text, r.n_chars) for r in second.collect()}
    assert second.columns == names and left == {d: (want[d][0], len(want[d][0])) for d, *_ in kept if d is not None and words(want[d][0])}
    third = corpus_pipeline.near_duplicates(spark, docs, "")
    comp = jaccard_components([r for r in rows if r[0] is not None], 80)
    assert third.columns == names and {r.doc_id for r in third.collect()} == {None} | {d for d, (_, c) in comp.items() if c == d}
    fourth = corpus_pipeline.mix_sources(spark, third, "")
    assert fourth.columns == names
    last = corpus_pipeline.tokenize(spark, fourth, "")
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"] and last.count() == fourth.count()


def test_stages_keep_columns_named_like_their_own(spark):
    docs = data.frame(spark, data.rows())
    mine = ["lang_pred", "score", "deleted_lines", "draws", "of", "of_id", "words", "mix_words", "mix_draw", "mix_shard", "mix_epoch"]
    marked = docs.withColumns({c: F.concat(F.lit(c + " of "), F.col("doc_id").cast("string")) for c in mine})
    for stage in (corpus_pipeline.language_id, corpus_pipeline.line_dedup, corpus_pipeline.mix_sources):
        out = stage(spark, marked, "")
        rows = out.collect()
        assert out.columns == marked.columns and len(rows) == stage(spark, docs, "").count() > 0
        assert all(r[c] == (None if r.doc_id is None else f"{c} of {r.doc_id}") for r in rows for c in mine)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF0001)
    assert out.count() > 100 and len(corpus_pipeline.STAGES) == 5
