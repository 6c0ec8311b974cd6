"""BPE encoding and decoding with a tokenization automaton.

The automaton accepts exactly the token sequences that the merges produce.
It starts with one state that has an arc to itself for every symbol. Each
merge (u, v) -> w, in order of rank, is a gadget: the state that u leads to
is split off without its arc v, so u and v can no longer stand side by side,
and every state with an arc u (and the arc v behind it) gets an arc w to
where v leads. A token therefore leads to one state, and a state differs from
the start by gadgets only. It is kept as a list of segments
``(token, until)``: all gadgets ``(token, .)`` of rank below ``until`` have
taken their arc away. Merge (u, v) gives w the segments of v as they are at
that rank; a later gadget of u shows in u's own first segment.

Encoding reads a word byte by byte through a transition table. A state of
the table holds the longest suffix read that may still begin a token and, for
each position in it, the arc that enters that position on the word's only
path: of all tokens that end at a position exactly one continues such a path.
The table is filled as transitions are met. The distinct new words of a batch
advance through it in lock step, a byte at a time, and their paths are read
back in lock step too. Decoding emits the labels of the arcs that the ids name.

The word splitter is that of the tokenizer file: special tokens first, then
normal form C, white space to one space, lower case, and the split pattern.
What is a letter or digit, and its lower case, is asked of the tokenizer
library's own tables when the file is loaded: Python's and ``regex``'s are of other
Unicode versions.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Regex, normalizers

from tarmac.llm.common import small_batches

# Bounds of a worker's memory, some 40 MB each: chunks of text kept, of at most
# so many characters, and states of the transition table; both start anew beyond.
CACHED, CACHED_CHARS = 200_000, 40
STATES = 150_000
SLICE = 1 << 20        # characters of text turned into one output batch
LOCK_STEP = 64         # bytes; longer words are walked by themselves
_NEVER = 1 << 60
_START, _NONE = -1, -2  # in the place of an arc: the word's start; a position on no path


def byte_symbols() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Automaton:
    """The compiled merges; plain data, so that it can be broadcast. Its size
    is that of the vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.end = end
        self.labels = {i: t for t, i in vocab.items()}
        self.gadget: dict[tuple[int, int], int] = {}        # (u, v): rank
        self.made: dict[int, tuple[int, int, int]] = {}     # w: (rank, u, v)
        self.states: dict[int, list[tuple[int, int]]] = {}  # token: segments of the state it leads to
        self.arcs: dict[str, int] = {}                      # label: token, of all live arcs
        parts = {x for pair in merges for x in pair} - {a + b for a, b in merges}
        for t, i in vocab.items():
            if t in parts or len(t.removesuffix(end) or t) == 1:
                self.states[i] = [(i, _NEVER)]
                self.arcs[t] = i
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u not in self.states or v not in self.states or w in self.made or not self._open(u, v, rank):
                continue                                    # u and v never meet: no arc changes
            self.gadget[u, v] = rank
            self.made[w] = (rank, u, v)
            self.states[w] = [(w, _NEVER), *((t, min(until, rank)) for t, until in self.states[v])]
            self.arcs[a + b] = w

    def _open(self, last: int, arc: int, rank: int = _NEVER) -> bool:
        """Whether the state behind ``last`` has the arc at that rank. The arc
        of a merge was added where its left part was open at the time."""
        while True:
            for token, until in self.states[last]:
                if self.gadget.get((token, arc), _NEVER) < min(until, rank):
                    return False
            if arc not in self.made:
                return True
            made, left, _ = self.made[arc]
            # a gadget of this very rank is the pair (left, left): it too closes the left part
            rank, arc = min(rank, made + 1), left

class Table:
    """Transition table of an automaton over bytes, filled lazily."""

    def __init__(self, automaton: Automaton, symbols: list[str]):
        self.automaton, self.symbols = automaton, symbols
        self.stems = {t.removesuffix(automaton.end)[:k] if automaton.end else t[:k]
                      for t in automaton.arcs for k in range(len(t))}
        self.clear()

    def clear(self) -> None:
        self.known = {("", (_START,)): 0}
        self.held: list[tuple[str, tuple[int, ...]]] = [("", (_START,))]  # suffix; arc into each of its positions
        self.entry: list[tuple[int, int]] = [(_START, 0)]                 # arc into the position read last; its length
        self.step: dict[int, int] = {}                                    # state * 256 + byte: state
        self.last: dict[int, tuple[int, int]] = {}                        # the same for a word's last byte: arc, length
        self.live: dict[tuple[int, int], bool] = {}

    def _arc(self, state: int, ending: str) -> tuple[int, int]:
        """The arc whose label ends with the symbol ``ending`` read from this
        state and that continues a path; its length in symbols."""
        suffix, into = self.held[state]
        for at, before in enumerate(into):
            arc = self.automaton.arcs.get(suffix[at:] + ending)
            if arc is None or before == _NONE:
                continue
            if before != _START:
                live = self.live.get((before, arc))
                if live is None:
                    live = self.live[before, arc] = self.automaton._open(before, arc)
                if not live:
                    continue
            return arc, len(suffix) - at + 1
        return _NONE, 1

    def _next(self, state: int, byte: int) -> int:
        suffix, into = self.held[state]
        found = self._arc(state, self.symbols[byte])
        suffix, into = suffix + self.symbols[byte], (*into, found[0])
        cut = next(i for i in range(len(suffix) + 1) if suffix[i:] in self.stems)
        key = suffix[cut:], into[cut:]
        new = self.known.get((key, found[1]))
        if new is None:
            new = self.known[key, found[1]] = len(self.held)
            self.held.append(key)
            self.entry.append(found)
        self.step[state * 256 + byte] = new
        return new

    def _last(self, key: int) -> tuple[int, int]:
        found = self.last.get(key)
        if found is None:
            found = self.last[key] = self._arc(key >> 8, self.symbols[key & 255] + self.automaton.end)
        return found

    def path(self, word: bytes) -> list[int]:
        """Tokens of one word."""
        states, step = [0], self.step
        for byte in word[:-1]:
            new = step.get(states[-1] * 256 + byte)
            states.append(self._next(states[-1], byte) if new is None else new)
        arc, length = self._last(states[-1] * 256 + word[-1])
        out, at = [arc], len(word) - length
        while at:
            arc, length = self.entry[states[at]]
            out.append(arc)
            at -= length
        out.reverse()
        return out

    def paths(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Tokens (int32) of distinct words."""
        if len(self.held) >= STATES:
            self.clear()
        found = {w: np.array(self.path(w), np.int32).tobytes() for w in words if len(w) > LOCK_STEP}
        words = sorted((w for w in words if len(w) <= LOCK_STEP), key=len, reverse=True)
        if not words:
            return found
        sizes = np.array([len(w) for w in words])
        longest, n = int(sizes[0]), len(words)
        read = np.frombuffer(b"".join([w.ljust(longest, b"\0") for w in words]), np.uint8).reshape(n, longest)
        states = np.zeros((longest, n), np.int64)           # before each byte
        for k in range(longest - 1):
            m = int(np.searchsorted(-sizes, -(k + 1), side="left"))     # words with a byte after k
            keys, place = np.unique(states[k, :m] * 256 + read[:m, k], return_inverse=True)
            to = [self.step.get(x) for x in keys.tolist()]
            for i, x in enumerate(to):
                if x is None:
                    to[i] = self._next(int(keys[i]) >> 8, int(keys[i]) & 255)
            states[k + 1, :m] = np.array(to)[place]
        word = np.arange(n)
        keys, place = np.unique(states[sizes - 1, word] * 256 + read[word, sizes - 1], return_inverse=True)
        ends = np.array([self._last(x) for x in keys.tolist()])[place]
        entry = np.array(self.entry)
        arcs, owners, at = [ends[:, 0]], [word], sizes - ends[:, 1]
        while len(word := word[at > 0]):
            at = at[at > 0]
            step = entry[states[at, word]]
            arcs.append(step[:, 0])
            owners.append(word)
            at = at - step[:, 1]
        owner = np.concatenate(owners)
        # a word's arcs were found last first
        order = np.lexsort((-np.repeat(np.arange(len(owners)), [len(x) for x in owners]), owner))
        ids = np.concatenate(arcs)[order].astype(np.int32).tobytes()
        stop = np.cumsum(np.bincount(owner, minlength=n)) * 4
        for w, i, j in zip(words, [0, *stop.tolist()], stop.tolist()):
            found[w] = ids[i:j]
        return found


@lru_cache(maxsize=2)
def library_tables() -> tuple[dict[int, str], dict[int, str]]:
    """What the tokenizer library's tables hold of each code point where
    Python's or ``regex``'s differ: a character of the same class (letter, digit or neither),
    and its lower case."""
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    whole = "".join(chars)

    def of(name: str) -> set[str]:
        return set(chars).difference(normalizers.Replace(Regex(f"[\\p{{{name}}}]+"), "").normalize_str(whole))
    letters, digits = of("L"), of("N")
    known_letters, known_digits = set(regex.findall(r"\p{L}", whole)), set(regex.findall(r"\p{N}", whole))
    alphas = {c for c in chars if c.isalpha()}
    classes = {ord(c): "a" if c in letters else "1" if c in digits else "\ue000"
               for c in (known_letters ^ letters) | (known_digits ^ digits) | (alphas ^ letters)}
    lower = normalizers.Lowercase().normalize_str("\0".join(chars)).split("\0")
    folded = {ord(c): x for c, x in zip(chars, lower) if x != c.replace("Σ", "σ").lower()}
    return classes, folded


class Tokenizer:
    """Encoder and decoder of one tokenizer file (``tokenizers`` format, BPE
    model with a word end suffix, no decoder: labels joined by a space)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.symbols = byte_symbols()
        self.classes, self.folded = library_tables()
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.table = Table(self.automaton, self.symbols)
        self.chunks: dict[str, bytes] = {}
        names = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.labels = pa.array([names.get(i) for i in range(max(names) + 1)], pa.large_string())

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("automaton", "special", "pattern", "symbols", "classes", "folded")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _words(self, chunk: str) -> list[bytes]:
        """Words of a stretch without a plain space, line break or special token."""
        if chunk.isascii():
            text = plain = chunk.lower()
        else:
            # lower case works character by character: capital sigma has no final form here
            text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            points = set(map(ord, text))
            if not self.folded.keys().isdisjoint(points):
                text = text.translate(self.folded)
            plain = text if self.classes.keys().isdisjoint(points) else text.translate(self.classes)
        words = [text] if plain.isalpha() else [text[m.start():m.end()] for m in self.split.finditer(plain)]
        return [w.encode("utf-8", "replace") for w in words]

    def _parts(self, text: str | None) -> list[str | bytes]:
        """Chunks of a whole text, and special tokens as their ids."""
        if not text:
            return []
        spans = [m.span() for m in self.marks.finditer(text)] if "<|" in text else []
        if not spans:
            return text.replace("\n", " ").split(" ")
        out: list[str | bytes] = []
        at = 0
        for a, b in [*spans, (len(text), len(text))]:
            out += text[at:a].replace("\n", " ").split(" ")
            if a < b:
                out.append(np.int32(self.special[text[a:b]]).tobytes())
            at = b
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids (int32) of whole texts."""
        parts = [self._parts(t) for t in texts]
        used = set().union(*parts)
        new = [p for p in used if type(p) is str and p not in self.chunks]
        if len(self.chunks) + len(new) > CACHED:
            self.chunks = {}
            new = [p for p in used if type(p) is str]
        words = [self._words(c) for c in new]
        ids = self.table.paths(list({w for ws in words for w in ws}))
        self.chunks.update((c, b"".join([ids[w] for w in ws])) for c, ws in zip(new, words))
        known = self.chunks.get
        out = [b"".join([known(p, p) for p in x]) for x in parts]
        for c in new:
            if len(c) > CACHED_CHARS:
                del self.chunks[c]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], np.int32).tolist()

    def decode_arrays(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Labels of each row's ids joined by a space; ids that the vocabulary
        lacks are skipped. Row i's ids are ``ids[ends[i]:ends[i + 1]]``."""
        there = (ids >= 0) & (ids < len(self.labels))
        labels = self.labels.take(pa.array(np.where(there, ids, 0)))
        there &= labels.is_valid().to_numpy(zero_copy_only=False)
        rows = np.concatenate(([0], np.cumsum(there)))[ends]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(rows.astype(np.int64), labels.filter(pa.array(there))), pa.scalar(" ", pa.large_string()))
        return joined.cast(pa.string())

    def decode(self, ids: list[int] | None) -> str:
        found = np.array(ids or [], np.int64)
        return self.decode_arrays(found, np.array([0, len(found)]))[0].as_py()


def load(path: str) -> Tokenizer:
    """Read the vocabulary file on the driver; executors get the compiled
    automaton by broadcast (some MB, bounded by the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return Tokenizer(f.read())


def _sliced(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with a bounded amount of text, one row at least."""
    start = size = 0
    for i in range(batch.num_rows):
        n = len(batch.column(at)[i].as_py() or "") if batch.num_rows > 1 else 0
        if size and size + n > SLICE:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def _encode(it: Iterator[pa.RecordBatch], sent, names: list[str], labels: bool) -> Iterator[pa.RecordBatch]:
    """The text is the last column; it doesn't come back."""
    tokenizer = sent.value
    for batch in it:
        for b in _sliced(batch, batch.num_columns - 1):
            found = tokenizer.encode_batch(b.columns[-1].to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            flat = np.frombuffer(b"".join(found), np.int32)
            out = [*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *([tokenizer.decode_arrays(flat, ends)] if labels else [])]
            yield pa.RecordBatch.from_arrays(out, names=names)
        pa.default_memory_pool().release_unused()   # workers live on into other stages


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
                     decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if not named) with the token ids
    of the whole text (null: no tokens) as array<int> ``ids_col``, and the
    decoded ids as string ``decoded_col`` if named. Columns of these
    names are replaced; every row, repeated ones too, is encoded by itself.
    Empty tables stay empty."""
    small_batches(docs.sparkSession)
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    sent = docs.sparkSession.sparkContext.broadcast(load(path))
    fields = [StructField(ids_col, ArrayType(IntegerType())), StructField(decoded_col or "", StringType())][:len(new)]
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("text to encode")).mapInArrow(
        partial(_encode, sent=sent, names=[*kept, *new], labels=bool(decoded_col)),
        StructType([*plain.schema.fields, *fields]))


def _decode(it: Iterator[pa.RecordBatch], sent, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ids = pc.fill_null(b.column(at), pa.scalar([], b.column(at).type))
        sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, sent.value.decode_arrays(flat, np.concatenate(([0], np.cumsum(sizes))))], names=names)


def decode_documents(docs: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the labels of ``ids_col`` (null: none; ids that the
    vocabulary lacks are skipped) joined by a space as ``decoded_col``."""
    kept = [c for c in docs.columns if c != decoded_col]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    sent = docs.sparkSession.sparkContext.broadcast(load(path))
    return plain.mapInArrow(partial(_decode, sent=sent, at=kept.index(ids_col), names=[*kept, decoded_col]),
                            StructType([*plain.schema.fields, StructField(decoded_col, StringType())]))


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of every text."""
    coded = encode_documents(docs, path, text_col, "ids", "decoded", keep=[id_col])
    return coded.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
