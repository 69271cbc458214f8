"""Counts that the quality operators share, for every text of a batch at once."""

from __future__ import annotations

import numpy as np

from lodeflow.llm.words import Texts, Words, running, window_starts, windows, within

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def first_seen(key: np.ndarray) -> np.ndarray:
    """True at the first place of each key."""
    seen = np.zeros(len(key), bool)
    if len(key):
        seen[np.unique(key, return_index=True)[1]] = True
    return seen


def lead_bytes(data: np.ndarray) -> np.ndarray:
    """True at each code point's first byte."""
    return (data & 0xC0) != 0x80


def word_chars(texts: Texts, words: Words) -> np.ndarray:
    leads = running(lead_bytes(texts.data))
    return np.diff(running(leads[words.ends] - leads[words.starts])[words.bounds])


def symbols(texts: Texts) -> np.ndarray:
    return texts.per_text(_SYMBOL[texts.data])


def repeated_lines(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """By text: lines with a word that equal an earlier line, and lines with a word."""
    starts, ends = texts.spans(texts.data != 10)
    inside = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[inside], ends[inside]
    owner = np.searchsorted(texts.offsets, starts, "right") - 1
    again = ~first_seen(within(texts.hashes(starts, ends), owner))
    return np.bincount(owner[again], minlength=len(texts)), np.bincount(owner, minlength=len(texts))


def words_in_repeats(words: Words, size: int = 5) -> np.ndarray:
    """By text: words inside windows of size words that the text holds twice or more."""
    starts, owner = window_starts(words.bounds, size)
    key = within(windows(words.hashes, size)[starts], owner)
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.bincount(starts[twice], minlength=len(words.starts) + 1) - np.bincount(starts[twice] + size, minlength=len(words.starts) + 1)[: len(words.starts) + 1]
    covered = np.cumsum(change)[: len(words.starts)] > 0
    return np.diff(running(covered)[words.bounds])


def distinct_words(words: Words) -> np.ndarray:
    owner = words.text_of()
    return np.bincount(owner[first_seen(within(words.hashes, owner))], minlength=len(words.bounds) - 1)
