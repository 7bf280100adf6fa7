"""Counts of a text that quality operators share, for a slice of rows at a time."""

from __future__ import annotations

import numpy as np

from llm import words as W

SYMBOLS = b"#*$%&|<>"


def per_row(part: W.Slice, marked: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked; marked has a flag for each byte value."""
    total = np.zeros(len(part.data) + 1, np.int64)
    np.cumsum(marked[part.data], out=total[1:])
    return total[part.offsets[1:]] - total[part.offsets[:-1]]


def flags(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


WORD_CHAR = np.array([not W.SPACE[b] and b & 0xC0 != 0x80 for b in range(256)])  # the first byte of each code point of a word
SYMBOL = flags(SYMBOLS)


def repeats(key_row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each (row, hash): its number among equal ones, 0 for the first, and whether there are others."""
    order = np.lexsort((key, key_row))
    r, h = key_row[order], key[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (r[1:] != r[:-1]))))
    length = np.diff(np.append(begin, len(h)))
    nth, many = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    nth[order] = np.arange(len(h)) - np.repeat(begin, length)
    many[order] = np.repeat(length, length)
    return nth, many


def lines(part: W.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each \\n-split line that has a word; lines are compared byte by byte, so blanks count."""
    whole = np.full(256, False)
    whole[10] = True
    n = len(part.data)
    cut = np.unique(np.concatenate((np.flatnonzero(whole[part.data]), part.offsets[1:-1] - 1, [n - 1]))) if n else np.zeros(0, int)
    start = np.concatenate(([0], cut[:-1] + 1)) if n else cut
    end = cut + 1 - (part.data[cut] == 10) if n else cut
    row = np.searchsorted(part.offsets, start, side="right") - 1
    first_word = np.searchsorted(part.start, start)
    has = (first_word < len(part.start)) & (part.start[np.minimum(first_word, len(part.start) - 1)] < end) if len(part.start) else np.zeros(len(start), bool)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(W._LETTER[part.data] * W.powers(W._BASE, n), out=total[1:])
        h = W.mix((total[end] - total[start]) * W.powers(W._INVERSE, n + 1)[start])
    return row[has], h[has]


def base(part: W.Slice) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    h = part.hashes()
    n_words = np.diff(part.words)
    line_row, line = lines(part)
    dup = np.bincount(line_row[repeats(line_row, line)[0] > 0], minlength=part.rows) if len(line) else np.zeros(part.rows, np.int64)
    repeated = np.zeros(len(h) + 2, bool)
    if len(h) >= 3:
        window = np.flatnonzero(part.row[2:] == part.row[:-2])
        many = repeats(part.row[window], W.grams(h, 3)[window])[1] > 1
        for k in range(3):
            repeated[window[many] + k] = True
    rep = np.bincount(part.row[repeated[: len(h)]], minlength=part.rows)
    return {"n_words": n_words, "word_chars": per_row(part, WORD_CHAR), "n_symbols": per_row(part, SYMBOL), "n_dup_lines": dup, "n_repeat_words": rep}
