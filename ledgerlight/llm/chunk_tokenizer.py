"""Byte-level BPE ids of whole texts, each distinct part of a batch encoded once.

The tokenizer's own pre-tokenizer always starts a new token at a space that a
character other than white space follows, so a text may be cut there: the ids of the
parts, each with its leading space, are the ids of the text. The distinct parts of a batch are encoded in
one call and then laid out per text by index. The vocabulary is read as ranks, from which the same ids follow as
from the same vocabulary's merges in the ``tokenizers`` library (the tests compare them), at a fraction
of its CPU time; parts of more than ``LONG`` characters, for which ranks take quadratic time, go to that library itself. If
the library's added tokens are given, a text is split at them first, as the library does by default: the
parts between them are texts of their own.

Nothing is kept from one batch to the next, so memory is bounded by a batch's bytes.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

from .words import cut, ranges, words_of

#: Longer parts are encoded by the ``tokenizers`` library.
LONG = 4096
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")


class ChunkTokenizer:
    def __init__(self, path: str, pattern: str, added: tuple[tuple[str, int], ...] = (), library: str = ""):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        tool = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.rank_ids = tool.encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.library, self._tool = library, None
        self.added = {mark: np.array([number], dtype="<u4").tobytes() for mark, number in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None

    def ids(self, part: str) -> list[int]:
        """The ids of one text without added tokens."""
        if len(part) <= LONG or not self.library:
            return self.rank_ids(part)
        if self._tool is None:
            from tokenizers import Tokenizer

            self._tool = Tokenizer.from_file(self.library)
            self._tool.encode_special_tokens = True
        return self._tool.encode(part, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers, one after the other."""
        plain: list[str] = []
        made: list[list[bytes | int]] = []  # per text: bytes of added tokens, and places in ``plain``
        for text in texts:
            pieces = self.marks.split(text) if self.marks is not None and self.marks.search(text) else [text]
            own: list[bytes | int] = []
            for n, piece in enumerate(pieces):
                if n % 2:
                    own.append(self.added[piece])
                else:
                    parts = cut(piece)
                    own.extend(range(len(plain), len(plain) + len(parts)))
                    plain.extend(parts)
            made.append(own)
        done = self._plain(plain)
        return [done[x[0]] if len(x) == 1 else b"".join([done[i] if isinstance(i, int) else i for i in x]) for x in made]

    def _plain(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        words = words_of(texts, lambda t: _ODD.search(t) is not None, _CUT.split)
        first = words.number[words.before[:-1]]
        heads = [self.ids(words.distinct[n]) for n in first.tolist()]
        if words.size.max() > LONG:
            return self._one_by_one(words, heads)
        by_size = np.where(words.size > 0, words.size + 1, 0)  # only a text's first part may be empty; it is a head
        joined = " ".join(["", *filter(None, words.distinct)])
        ids = np.array(self.rank_ids(joined), dtype=np.uint32)
        ends = np.searchsorted(np.r_[0, np.cumsum(self.size[ids])], np.cumsum(by_size))
        start = np.r_[0, ends[:-1]]
        return self._laid_out(words, heads, ids, start, ends - start)

    def _one_by_one(self, words, heads) -> list[bytes]:
        made = [np.array(self.ids(" " + w if w else ""), dtype=np.uint32) for w in words.distinct]
        size = np.array([len(x) for x in made])
        return self._laid_out(words, heads, np.concatenate(made), np.cumsum(size) - size, size)

    @staticmethod
    def _laid_out(words, heads, ids, start, size) -> list[bytes]:
        of = words.number.copy()
        counts = size[of]
        counts[words.before[:-1]] = 0
        raw = ids[ranges(start[of], counts)].astype("<u4").tobytes()
        places = np.r_[0, np.cumsum(counts)][words.before].tolist()
        return [
            np.array(head, dtype="<u4").tobytes() + raw[4 * a : 4 * b]
            for head, a, b in zip(heads, places, places[1:], strict=False)
        ]


@cache
def chunk_tokenizer(path: str, pattern: str, added: tuple[tuple[str, int], ...] = (), library: str = "") -> ChunkTokenizer:
    """One per Python worker and vocabulary."""
    return ChunkTokenizer(path, pattern, added, library)
