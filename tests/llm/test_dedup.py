import hashlib
import re

from pyspark.sql import functions as F

from tarmac.llm import exactdedup, linededup, minhash
from tests.llm import data


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def exact(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), d is None, d))
    out = []
    for d, t, *_ in rows:
        g = groups[squeezed(t)]
        best = min(g, key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((d, best[2], len(g), (-len(t or ""), d is None, d) == best, hashlib.sha256(squeezed(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_is_brute_force(spark):
    got = exactdedup.dedup_exact(data.frame(spark))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == exact(data.rows())


def test_exact_dedup_compares_contents_of_one_digest(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3), "en", "s") for i in range(60)]
    got = exactdedup.dedup_exact(data.frame(spark, rows), salts=3, digest=lambda c: F.substring(F.sha2(c, 256), 1, 0))
    assert sorted(map(tuple, got.collect()), key=str) == exact(rows)


def test_exact_dedup_of_nothing(spark):
    assert exactdedup.dedup_exact(data.frame(spark, [])).collect() == []


def jaccard_components(rows, percent):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
        sets.setdefault(minhash.LAST_ID if d is None else d, set()).update(s)
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {d: (len(sets[d]), comp[d]) for d in sets}


def near_rows():
    """Chains of near copies: each differs in a word from the one before."""
    out = []
    for g in range(4):
        words = data.prose(50 + g, 120).split()
        for k in range(9):
            words = list(words)
            words[(k * 13) % 120] = f"new{g}x{k}"
            out.append((g * 20 + k, " ".join(words), "en", "s"))
    return out


def check_near(spark, rows, percent=85):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(data.frame(spark, rows), percent=percent).collect()}
    want = {d: (n, c, d == c) for d, (n, c) in jaccard_components(rows, percent).items()}
    assert got == want


def test_near_duplicates_are_brute_force(spark):
    rows = [r for r in data.rows() if r[0] is not None]
    check_near(spark, rows + [(r[0] + 100, *r[1:]) for r in near_rows()])


def test_near_duplicates_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STARS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    check_near(spark, near_rows(), 80)


def test_near_duplicates_with_null_ids_and_nothing(spark):
    got = minhash.near_duplicates(data.frame(spark, [(None, "a b c d e f", "en", "s"), (None, None, None, None), (4, "a b c d e f", "en", "s")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 4), (4, 2, 4)]
    assert minhash.near_duplicates(data.frame(spark, [])).collect() == []


def test_estimate_corrects_for_chance():
    a, b = minhash.minima(minhash.shingles(data.prose(1, 3000))), minhash.minima(minhash.shingles(data.prose(2, 3000)))
    sig = [minhash.np.frombuffer(minhash.packed(x), minhash.np.uint8) for x in (a, b)]
    assert abs(minhash.estimate(sig[0], sig[1])) < 0.15 and minhash.estimate(sig[0], sig[0]) == 1


def line_brute(rows):
    """Sequential: fingerprints against their first holder, run by run."""
    order = sorted({(linededup.LAST_ID if d is None else d, t) for d, t, *_ in rows if t}, key=lambda r: r[0])
    first, held, out = {}, {}, {}
    for d, t in order:
        h, w = linededup.line_hashes(t)
        held[d] = h
        found = linededup.fingerprints(h, w)
        gone = [False] * len(h)
        for lo, hi in linededup.own_repeats(h, found):
            gone[lo:hi] = [True] * (hi - lo)
        own = list(gone)
        for at, x in found:
            if own[at]:
                continue
            s, q = first.setdefault(x, (d, at))
            if s == d:
                continue
            lo, hi = at, at
            while lo and q - (at - lo) > 0 and h[lo - 1] == held[s][q - (at - lo) - 1]:
                lo -= 1
            while hi < len(h) and q + hi - at < len(held[s]) and h[hi] == held[s][q + hi - at]:
                hi += 1
            gone[lo:hi] = [True] * (hi - lo)
        out[d] = ("\n".join(x for x, g in zip(t.split("\n"), gone) if not g) if any(gone) else t, sum(gone))
    return out


def check_lines(spark, rows):
    want = line_brute(rows)
    got = linededup.dedup_lines(data.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None or not want.get(linededup.LAST_ID if r.doc_id is None else r.doc_id):
            assert r.deleted_lines == 0
        else:
            assert (r.text, r.deleted_lines) == want[linededup.LAST_ID if r.doc_id is None else r.doc_id]
    return {r.doc_id: r for r in got}


def test_line_dedup_is_brute_force(spark):
    got = check_lines(spark, data.rows())
    assert got[1].deleted_lines == 0 and got[2].text == "" and got[4].deleted_lines == 0
    assert got[5].text.split("\n") == data.lines(3, 6)[:2] + data.lines(3, 6)[2:]
    assert 0 < got[16].deleted_lines < 30          # a document's own first lines stay


def test_line_dedup_extends_over_long_runs(spark, monkeypatch):
    monkeypatch.setattr(linededup, "REACH", 3)
    shared = data.lines(7, 40, 3)
    rows = [(i, "\n".join(data.lines(100 + i, i) + shared + data.lines(200 + i, 2)), "en", "s") for i in range(1, 6)]
    got = check_lines(spark, rows)
    assert [got[i].deleted_lines for i in range(1, 6)] == [0, 40, 40, 40, 40]


def test_a_window_long_run_is_always_found():
    import numpy as np
    for seed in range(30):
        shared = data.lines(seed, 4, 3)
        pos = []
        for side in (1, 2):
            h, w = linededup.line_hashes("\n".join(data.lines(1000 + seed * 2 + side, 5, 4) + shared + data.lines(5000 + seed * 2 + side, 5, 4)))
            assert isinstance(h, np.ndarray)
            pos.append({x for _, x in linededup.fingerprints(h, w)})
        assert pos[0] & pos[1]


def test_line_dedup_of_nothing(spark):
    assert linededup.dedup_lines(data.frame(spark, [])).collect() == []


def test_line_dedup_of_lines_repeated_directly(spark):
    """Whole copies of a document whose own repeats cover its fingerprints."""
    a = data.lines(31, 3, 12)
    rows = [(1, "\n".join([a[0]] * 6), "en", "s"), (2, "\n".join([a[0]] * 6), "en", "s"),
            (3, "\n".join([a[1]] * 2 + [a[2]] * 9 + a[1:]), "en", "s"), (4, "\n".join([a[1]] * 2 + [a[2]] * 9 + a[1:]), "en", "s")]
    got = {r.doc_id: r for r in linededup.dedup_lines(data.frame(spark, rows)).collect()}
    assert got[2].text == "" and got[4].text == ""
    assert a[0] in got[1].text and {a[1], a[2]} == set(got[3].text.split("\n"))


def qualifying(text):
    """All runs of a text of at least four lines or 50 words, as (from, to),
    between lines with a word; and the lines."""
    lines = text.split("\n")
    n = [len(x.split()) for x in lines]
    full = [i for i, k in enumerate(n) if k]
    return lines, [(a, b + 1) for x, a in enumerate(full) for y, b in enumerate(full) if y >= x and (y - x >= 3 or sum(n[a:b + 1]) >= 50)]


def test_every_repeated_window_goes(spark):
    """Checked on strings, without fingerprints: no line stays that lies in a
    run of a window's length that stood before."""
    import random
    rnd = random.Random(7)
    pool = [*data.lines(41, 9, 5), *data.lines(42, 3, 55), "", ""]
    rows = [(i, "\n".join([*data.lines(300 + i, 1, 7), *[x for x in rnd.choices(pool, k=rnd.randint(3, 14)) for _ in range(rnd.choice([1, 1, 1, 3]))]]), "en", "s")
            for i in range(150)]
    # a first holder of the unit alone, then a longer passage that two later documents share
    a, b = data.lines(51, 2, 9), data.lines(52, 6, 4)
    rows += [(1000 + k, "\n".join([*data.lines(400 + k, 2), *a, *(b if k else []), *data.lines(500 + k, 2)]), "en", "s") for k in range(4)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(data.frame(spark, rows)).collect()}
    seen, partial = set(), 0
    for d, t, *_ in rows:
        lines, runs = qualifying(t)
        due = set()
        for lo, hi in runs:
            k = tuple(lines[lo:hi])
            if k in seen:
                due.update(range(lo, hi))
            seen.add(k)
        left = [x for i, x in enumerate(lines) if i not in due and x]
        stays = [x for x in got[d].split("\n") if x]
        rest = iter(left)
        assert all(x in rest for x in stays), d         # no line that is due stays
        assert set(data.lines(300 + d, 1, 7) if d < 1000 else []) <= set(stays)
        partial += 0 < len(stays) < len(lines)
    assert partial > 50
    assert not set(b) & set(got[1002].split("\n")) and set(b) <= set(got[1001].split("\n"))


def test_windows_cover_every_qualifying_run():
    import random
    rnd = random.Random(3)
    for _ in range(300):
        t = "\n".join(rnd.choice(["", "a", "b c", "d " * 30, "e " * 60]) for _ in range(rnd.randint(1, 12)))
        found = [(lo, hi) for lo, hi, _ in linededup.windows(*linededup.line_hashes(t))]
        for lo, hi in qualifying(t)[1]:
            assert set().union(*[range(a, b) for a, b in found if lo <= a and b <= hi]) == set(range(lo, hi))


def shared_id_rows():
    """Null and repeated ids with other texts, near copies among them."""
    out = [(None if i % 3 else 5, t, "en", "s") for i, (_, t, *_) in enumerate(near_rows())]
    return out + [(r[0] + 100, *r[1:]) for r in near_rows()[::4]] + [(None, None, "en", "s"), (5, "", "en", "s")]


def check_shared_ids(spark, percent):
    import corpus_pipeline
    rows = shared_id_rows()
    # the same texts under numbers of their own, in the order of the ids
    order = sorted(range(len(rows)), key=lambda i: minhash.LAST_ID if rows[i][0] is None else rows[i][0])
    comp = jaccard_components([(at, *rows[i][1:]) for at, i in enumerate(order)], percent)
    want = sorted((str(rows[i][0]), comp[at][0], str(rows[order[comp[at][1]]][0])) for at, i in enumerate(order))
    got = minhash.near_duplicates(data.frame(spark, rows), percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert sum(r.kept for r in got) == len({c for _, c in comp.values()})
    if percent == corpus_pipeline.NEAR_PERCENT:
        texts = {rows[i][1]: comp[at][1] for at, i in enumerate(order)}
        left = [r.text for r in corpus_pipeline.near_duplicates(spark, data.frame(spark, rows), "").collect()]
        assert sorted(texts[t] for t in left) == sorted({c for _, c in comp.values()})


def test_near_duplicates_of_texts_that_share_an_id(spark):
    check_shared_ids(spark, 80)


def test_near_duplicates_of_texts_that_share_an_id_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STARS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    check_shared_ids(spark, 80)
