"""Structure statistics of whole texts, computed for batches in numpy; shared by the quality operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from bidlens.llm.wordhash import SPACE, mix, stretch_hashes, words

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "distinct", "echoes", "bare", "bangs",
    "digits", "lines", "symbol_words", "top_word",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


SYMBOLS = _table(b"#*$%&|<>")
UPPER, LETTERS = _table(bytes(range(65, 91))), _table(bytes(range(65, 91)) + bytes(range(97, 123)))
DIGITS, BANG = _table(b"0123456789"), _table(b"!")
HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])  # first byte of a character


def _within(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[cuts[1:]] - sums[cuts[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.empty(len(k), dtype=bool)
    out[order] = same[:-1] | same[1:]
    return out


def _first(keys: np.ndarray) -> np.ndarray:
    """Which keys occur for the first time (rows in order)."""
    out = np.zeros(len(keys), dtype=bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def text_stats(column: pa.Array):
    """For ranges of rows: first row, end row, counts (rows x COUNTS), ratios (rows x RATIOS), word cuts and hashes.

    Equality of words, lines and windows is equality of 64-bit hashes within one text. Null texts count as empty.
    """
    raw_bytes, raw_offs = _raw(column)
    for i, j, cut, h, s, e in words(column):
        n = j - i
        offs = raw_offs[i: j + 1] - raw_offs[i]
        buf = raw_bytes[raw_offs[i]: raw_offs[j]]
        n_words = np.diff(cut)
        doc = np.repeat(np.arange(n), n_words)
        salt = mix(doc.astype(np.uint64) + np.uint64(1))
        solid = ~SPACE[buf]
        word_chars = _within(solid & HEAD[buf], offs)
        symbol = SYMBOLS[buf]
        n_symbols = _within(symbol, offs)
        # lines: cut at newlines and at rows
        breaks = np.flatnonzero(buf == 10)
        starts = np.unique(np.concatenate((offs[:-1][offs[:-1] < offs[1:]], breaks + 1)))
        starts = starts[starts < len(buf)]
        ends = np.concatenate((starts[1:], [len(buf)]))[: len(starts)]
        owner = np.searchsorted(offs, starts, side="right") - 1
        ends = np.where((ends > starts) & (ends <= len(buf)) & (buf[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(buf) else ends
        filled = np.searchsorted(s, ends) > np.searchsorted(s, starts)
        starts, ends, owner = starts[filled], ends[filled], owner[filled]
        line_keys = mix(stretch_hashes(buf, starts, ends) ^ mix(owner.astype(np.uint64) + np.uint64(7)))
        n_lines = np.bincount(owner, minlength=n)[:n]
        n_dup = n_lines - np.bincount(owner[_first(line_keys)], minlength=n)[:n]
        # windows of five words
        covered = np.zeros(len(h), dtype=bool)
        if len(h) >= WINDOW:
            m = len(h) - WINDOW + 1
            key = salt[:m].copy()
            for k in range(WINDOW):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h[k: k + m])
            inside = doc[:m] == doc[WINDOW - 1:]
            at = np.flatnonzero(inside)
            at = at[_repeated(key[at])]
            for k in range(WINDOW):
                covered[at + k] = True
        n_repeat = _within(covered, cut)
        keyed = mix(h ^ salt)
        distinct = np.bincount(doc[_first(keyed)], minlength=n)[:n]
        echo = np.zeros(len(h), dtype=bool)
        echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        sums = np.concatenate(([0], np.cumsum(LETTERS[buf], dtype=np.int64)))
        bare = sums[e] == sums[s]
        high = np.concatenate(([0], np.cumsum(buf >= 128, dtype=np.int64)))
        bare &= high[e] == high[s]
        marks = np.concatenate(([0], np.cumsum(symbol, dtype=np.int64)))
        top = _top_share(keyed, doc, n)
        w = np.maximum(n_words, 1)
        letters = np.maximum(_within(LETTERS[buf], offs), 1)
        ratios = np.stack([
            np.log1p(n_words), word_chars / w, n_symbols / w, n_dup / np.maximum(n_lines, 1), n_repeat / w,
            _within(UPPER[buf], offs) / letters, distinct / w ** 0.85, _within(echo, cut) / w, _within(bare, cut) / w,
            _within(BANG[buf], offs) / w, _within(DIGITS[buf], offs) / w, n_lines / w, _within(marks[e] > marks[s], cut) / w,
            top / w,
        ], axis=1)
        counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], axis=1)
        yield i, j, counts, ratios, cut, h


def _top_share(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How often each row's most frequent word occurs."""
    out = np.zeros(n, dtype=np.int64)
    _, at, times = np.unique(keys, return_index=True, return_counts=True)
    np.maximum.at(out, doc[at], times)
    return out


def _raw(column):
    from bidlens.llm.wordhash import text_bytes

    return text_bytes(column)
