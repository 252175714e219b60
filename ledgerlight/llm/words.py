"""Texts of an Arrow column as words, each distinct word once, and values of words laid out per text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts and bytes of text that are worked on at once. A longer text is cut at spaces and put together again.
TEXTS_AT_ONCE = 4096
BYTES_AT_ONCE = 4 << 20
_BETWEEN = re.compile(r"(?<=[^\s]) (?=[^\s])")


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of a string column: TEXTS_AT_ONCE texts and, unless one text is longer, BYTES_AT_ONCE bytes at most."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.r_[0, np.cumsum(size)]
    at = 0
    while at < len(column):
        end = int(np.searchsorted(before, before[at] + BYTES_AT_ONCE, "right")) - 1
        end = min(max(end, at + 1), at + TEXTS_AT_ONCE, len(column))
        yield column.slice(at, end - at)
        at = end


def cut(text: str, most: int = BYTES_AT_ONCE) -> list[str]:
    """A text in parts of about ``most`` characters. All but the first begin with a single space between two words."""
    parts, at = [], 0
    while len(text) - at > most:
        found = _BETWEEN.search(text, at + most)
        if found is None:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


@dataclass
class Words:
    """Words of texts in order: the number of each in ``distinct``, and the words before each text's first.

    ``size``: the bytes of each distinct word.
    """

    distinct: list[str]
    size: np.ndarray
    number: np.ndarray
    before: np.ndarray


def words_of(texts: list[str], odd: Callable[[str], bool], split: Callable[[str], list[str]]) -> Words:
    """Split at each space inside Arrow; texts that are ``odd`` are split by ``split``."""
    strange = {n: split(t) for n, t in enumerate(texts) if odd(t)}
    lists = pc.split_pattern(pa.array(["" if n in strange else t for n, t in enumerate(texts)], pa.large_string()), " ")
    flat, before = lists.values, lists.offsets.to_numpy().astype(np.int64)
    if strange:
        own = list(strange.items())
        flat = pa.concat_arrays([flat, pa.array([w for _, ws in own for w in ws], flat.type)])
    coded = flat.dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    if strange:
        start, size = before[:-1].copy(), np.diff(before)
        at = int(before[-1])
        for n, ws in own:
            start[n], size[n] = at, len(ws)
            at += len(ws)
        number = number[ranges(start, size)]
        before = np.r_[0, np.cumsum(size)]
    size = pc.binary_length(coded.dictionary).to_numpy().astype(np.int64)
    return Words(coded.dictionary.to_pylist(), size, number, before)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same for the next, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total)
