import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from tarmac.llm import bpe, langid, qualityrules, textstats
from tarmac.llm.queries import TOKENIZER
from tests.conftest import SF0001
from tests.llm import data


def naive_stats(t):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(ls), len(ls) - len(set(ls)), len(covered))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b#é\x1c ", max_size=60))
def test_base_stats_are_the_definitions(t):
    assert textstats.base_stats(t) == naive_stats(t)


def test_quality_rules_edge_cases(spark):
    got = {r.doc_id: r for r in qualityrules.judge(data.frame(spark)).collect() if r.doc_id}
    for d, t, *_ in data.rows():
        if d:
            n, chars, symbols, _, dup, rep = naive_stats(t or "")
            r = got[d]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
            assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    assert got[1].kept and got[13].kept
    assert qualityrules.judge(data.frame(spark, [])).collect() == []


def test_quality_fences_follow_the_language(spark):
    good = [(i, data.prose(i, 80), "en", f"s{i % 2}") for i in range(300)]
    odd = [(1000, " ".join(f"{w}#$" for w in data.prose(5, 80).split()), "en", "s1"), (1001, " ".join(w * 9 for w in data.prose(6, 80).split()), "en", "s1")]
    got = {r.doc_id: r.kept for r in qualityrules.judge(data.frame(spark, good + odd)).collect()}
    assert not got[1000] and not got[1001] and sum(got.values()) >= 298


def test_each_metric_rejects_a_text_that_passes_the_base_rules(spark):
    """Texts of one group, ordinary but for one metric; and a group whose
    texts are shorter has a wider fence for symbols."""
    def text(i, words=120, n=12):
        w = data.prose(i, words).split()
        return "\n".join(" ".join(w[k::n]) for k in range(n))

    good = [(i, text(i), "en", "s1") for i in range(400)] + [(i, text(i, 60, 6), "fr", "s1") for i in range(400, 800)]
    w = data.prose(5, 120).split()
    odd = {
        1000: " ".join(x * 6 for x in w),
        1001: text(1001).replace(" ", " #", 30),
        1002: "\n".join("ja\nno\nbut\n" + " ".join(w[k:k + 6]) for k in range(0, 120, 6)),
        1003: text(1003) + "\n" + " ".join(w[:50]) + "\n" + " ".join(w[:50]).replace(w[0], "x", 1),
    }
    rows = data.frame(spark, good + [(i, t, "en", "s1") for i, t in odd.items()])
    got = {r.doc_id: r for r in qualityrules.judge(rows).collect()}
    assert all(not got[i].base_failed and not got[i].kept for i in odd), [got[i] for i in odd]
    assert all(got[i].kept for i in range(800))
    found = qualityrules.fences(qualityrules.text_stats(rows)).collect()
    high = {r["lang"]: [x["high"] for x in r["fences"]] for r in found}
    assert high["fr"][1] > high["en"][1] and high["fr"][2] > high["en"][2] and high["fr"][3] > high["en"][3]


def test_buckets_keep_six_leading_bits(spark):
    got = [r[0] for r in spark.range(0, 5000).select(qualityrules.bucket(qualityrules.F.col("id"))).collect()]
    want = [x if x < 64 else x >> (x.bit_length() - 6) << (x.bit_length() - 6) for x in range(5000)]
    assert got == want


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and held
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_edge_cases(spark):
    docs = data.frame(spark)
    got = langid.predict(docs, langid.train(docs))
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    by_text = {r.text: (r.lang_pred, r.score) for r in got.collect()}
    assert by_text[None] == by_text[""] == by_text["12 34 !? ###"] == ("und", 0.0)
    assert by_text["one two"][0] in ("en", "fr")
    empty = data.frame(spark, [])
    assert langid.train(empty) is None and langid.identify(empty).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_language_id_pieces_are_the_whole(monkeypatch):
    text = data.prose(3, 4000)
    whole = np.bincount(np.concatenate(list(langid.pieces(text))), minlength=langid.BUCKETS)
    monkeypatch.setattr(langid, "PIECE", 1000)
    parts = list(langid.pieces(text))
    assert len(parts) > 10 and abs(int(sum(map(len, parts))) - int(whole.sum())) <= 3 * len(parts)


@pytest.fixture(scope="module")
def coder():
    library = Library.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    return bpe.load(TOKENIZER), library


TEXTS = ["", " ", "it's I'LL we've 'd", "ΣΑΣ ΟΔΟΣ", "İstanbul ﬁne", "á ȩ́", "\x1ca\x85b\xa0c　d", "!!!??? 123 4", "aaaaaaaaaaaaaaaa",
         "<|startoftext|>Hello<|endoftext|> <|endoftext", "naïve café ＡＢ １２ 你好 🙂🙂", "x" * 3000, "a\n\nb\tc \r\n", "</w> w>"]


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_is_the_library(coder, text):
    mine, library = coder
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinorst hl'ABS\n.é"), st.characters(max_codepoint=0x24F, exclude_categories=["Cs", "Cn"])), max_size=40))
def test_bpe_on_random_text(coder, text):
    mine, library = coder
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_on_code_points(coder):
    """Every code point whose class or lower case the tables disagree on, and
    every 97th other one, in four contexts."""
    mine, library = coder
    points = sorted({*mine.classes, *mine.folded, *(c for c in range(1, 0x110000, 97) if not 0xD800 <= c < 0xE000)})
    for left, right in (("", ""), ("a", "b"), ("", "1"), ("x ", "'s")):
        texts = [left + chr(c) + right for c in points]
        want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        got = [np.frombuffer(x, np.int32).tolist() for x in mine.encode_batch(texts)]
        assert [hex(c) for c, a, b in zip(points, got, want) if a != b] == []


def test_lock_step_is_the_single_walk(coder, monkeypatch):
    table = bpe.Table(coder[0].automaton, coder[0].symbols)
    words = list({w.encode() for i in range(60) for w in data.prose(i, 60).split()} | {b"a", b"x" * 64, b"x" * 65, "naïveté".encode()})
    alone = bpe.Table(coder[0].automaton, coder[0].symbols)
    for size in (1, 7, len(words)):
        monkeypatch.setattr(bpe, "STATES", 10 if size == 7 else 150_000)
        for at in range(0, min(len(words), 40 * size), size):
            got = table.paths(words[at:at + size])
            assert {w: np.frombuffer(x, np.int32).tolist() for w, x in got.items()} == {w: alone.path(w) for w in words[at:at + size]}


def test_the_automaton_of_a_few_merges():
    """Against merging by rank, on all words up to length 7 over two symbols."""
    from itertools import product
    vocab = {t: i for i, t in enumerate(["a", "b", "aa", "ab", "aab", "ba", "aaaa", "bab"])}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("aa", "aa"), ("ba", "b"), ]
    vocab["bab"] = 7
    symbols = [chr(i) for i in range(256)]
    table = bpe.Table(bpe.Automaton(vocab, merges), symbols)
    for n in range(1, 8):
        for word in map("".join, product("ab", repeat=n)):
            parts = list(word)
            while True:
                ranks = [(merges.index((x, y)), i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if (x, y) in merges]
                if not ranks:
                    break
                _, i = min(ranks)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            assert table.path(word.encode()) == [vocab[p] for p in parts], word


def test_bpe_documents(spark, coder):
    docs = data.frame(spark)
    got = bpe.encode_documents(docs, TOKENIZER, decoded_col="decoded")
    assert got.columns == [*docs.columns, "ids", "decoded"]
    back = bpe.decode_documents(got.drop("decoded"), TOKENIZER).select("text", "ids", "decoded").collect()
    for r in back:
        ids = coder[1].encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == coder[1].decode(ids, skip_special_tokens=False)
    assert bpe.digest(data.frame(spark, []), TOKENIZER).collect() == []
    assert bpe.digest(docs, TOKENIZER).count() == len(data.rows())
