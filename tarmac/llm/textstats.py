"""Base statistics of a text; plain Python on one text at a time."""

from __future__ import annotations

import numpy as np

# Symbol characters and the ASCII white space that ends a word.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: str) -> list[bytes]:
    """``bytes.split`` splits at exactly the six ASCII white characters."""
    return text.encode("utf-8", "surrogatepass").split()


def repeat_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, window, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


def base_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words);
    null and empty texts count as nothing, ``n_lines`` are lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeat_words(words))
