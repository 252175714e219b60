"""Exact encoding with a merge-type SentencePiece model, and decoding.

An encoding by merges is the only sequence of pieces in which each two neighbours are
compatible: merging their joined characters by score yields the same two pieces. So
a text is encoded by backtracking over the pieces that an Aho-Corasick automaton
finds at each position, longest first; a piece is taken if it is compatible
with the one before, and a bit per position remembers where no continuation exists. Characters
without a piece are encoded as their bytes.

No piece holds a space mark after another character (checked at loading), so a text
splits before each run of spaces into chunks that are encoded by themselves. The distinct chunks of a batch are
laid one after the other, matched in one pass and backtracked in step; whether two pieces fit is worked out once per
pair. Long chunks are backtracked singly, cut first
wherever two characters stand side by side that do so in no piece. Ids and decoded bytes are laid out
per text by index. What a worker keeps between batches is bounded in bytes, however long chunks are.

Defined results: a null text is the empty text, which has only the begin and end
ids. Texts of any length are encoded whole. Rows that repeat an id stay rows of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import cut, ranges, slices, words_of

SPACE = "▁"
#: Pairs of pieces whose fit a worker keeps, and bytes of backtracked parts; beyond, it begins anew.
KEPT_PAIRS = 400_000
KEPT_BYTES = 48 << 20
#: What a kept part takes besides its characters and ids.
OVERHEAD = 300
#: From this many characters on, a part's matches lie in arrays instead of lists.
FLAT = 1 << 14
#: Chunks of at most SHORT characters are backtracked together, in STEPS choices of each.
SHORT = 64
STEPS = 256
TABLE_BITS = 20
#: Ids that are decoded at once.
DECODED_AT_ONCE = 1 << 20


class _Flat:
    """Pieces of all positions, one after the other."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        self.ids, self.first = ids, first

    def __getitem__(self, at: int) -> list[int]:
        return self.ids[self.first[at] : self.first[at + 1]].tolist()


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal, trained = model.normalizer_spec, model.trainer_spec
        kinds = type(model.pieces[0])
        if trained.model_type != 2 or not trained.byte_fallback:
            raise ValueError("a merge-type model with byte fallback is needed")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("a model that leaves texts as they are is needed")
        self.prefix = normal.add_dummy_prefix
        self.ids, self.scores, self.bytes_of, self.byte_id = {}, {}, [], {}
        self.begin, self.end = trained.bos_id, trained.eos_id
        for n, piece in enumerate(model.pieces):
            text = piece.piece
            if piece.type == kinds.BYTE:
                value = int(text[1:-1], 16)
                self.byte_id[value] = n
                self.bytes_of.append(bytes([value]))
            elif piece.type in (kinds.CONTROL, kinds.UNKNOWN):
                self.bytes_of.append(b"")
            else:
                if piece.type == kinds.USER_DEFINED or SPACE in text.lstrip(SPACE):
                    raise ValueError(f"piece {text!r} would cross chunks")
                self.ids[text], self.scores[text] = n, piece.score
                self.bytes_of.append(text.replace(SPACE, " ").encode())
        self.automaton = ahocorasick.Automaton()
        for text, n in self.ids.items():  # pieces of one character are looked up by themselves
            if len(text) > 1:
                self.automaton.add_word(text, n)
        self.automaton.make_automaton()
        self.text_of = {n: text for text, n in self.ids.items()}
        self.chars = np.zeros(len(self.bytes_of), dtype=np.int64)
        for text, n in self.ids.items():
            self.chars[n] = len(text)
        self.chars_of = self.chars.tolist()
        self.step = np.maximum(self.chars, 1)
        self.size = np.array([len(x) for x in self.bytes_of])
        self.place = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        #: By number of the left piece (0, the unknown mark, for none) and of the right one.
        self.compatible: dict[int, bool] = {}
        #: Pairs of characters that stand side by side in a piece: no merge crosses any other pair.
        self.joined = {pair for text in self.ids for pair in zip(text, text[1:], strict=False)}
        self.pair_at = np.full(1 << TABLE_BITS, -1, dtype=np.int64)
        self.pair_fits = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.parts: dict[str, list[int]] = {}
        self.held = 0

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best pair again and again."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= KEPT_PAIRS:
                self.compatible.clear()
            both = [self.text_of[n] for n in (left, right) if n]
            known = self.compatible[pair] = self.merged("".join(both)) == both
        return known

    def _single(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of one character, and their positions."""
        chars, char = np.unique(codes, return_inverse=True)
        piece = np.array([self.ids.get(chr(c), 0) for c in chars.tolist()], dtype=np.int64)[char]
        at = np.flatnonzero(piece)
        return piece[at], at

    def choices(self, text: str):
        """At each position the pieces that begin there, shortest first."""
        if len(text) < FLAT:
            out: list[list[int]] = [[self.ids[c]] if c in self.ids else [] for c in text]
            chars = self.chars_of
            for last, n in self.automaton.iter(text):  # ends come in order
                out[last - chars[n] + 1].append(n)
            return out
        found = np.fromiter((last << 32 | n for last, n in self.automaton.iter(text)), dtype=np.int64)
        single, at = self._single(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"))
        ids = np.r_[single, found & 0xFFFFFFFF]
        start = np.r_[at, (found >> 32) + 1 - self.chars[found & 0xFFFFFFFF]]
        order = np.argsort(start, kind="stable")
        return _Flat(ids[order].astype(np.int32), np.searchsorted(start[order], np.arange(len(text) + 1)))

    def backtracked(self, text: str) -> list[int]:
        """The ids of a text whose spaces are already marked: matches longest first, a bit per dead position."""
        choices, chars, known = self.choices(text), self.chars_of, self.compatible
        dead = bytearray(len(text) + 1)
        out: list[int] = []  # ids; a character without a piece is -1, after which nothing merges
        tried: list[int] = []  # of the pieces that begin where each of ``out`` does, those not yet tried
        at, left = 0, None
        while at < len(text):
            here = choices[at] or (-1,)
            before = max(out[-1], 0) if out else 0
            left = len(here) if left is None else left
            while left:
                left -= 1
                n = here[left]
                if not dead[at + (chars[n] if n >= 0 else 1)]:
                    fits = n < 0 or known.get(before << 32 | n)
                    if self.fits(before, n) if fits is None else fits:
                        tried.append(left)
                        out.append(n)
                        at += chars[n] if n >= 0 else 1
                        left = None
                        break
            else:
                dead[at] = 1
                if not out:
                    raise ValueError(f"no encoding for {text[:40]!r}")
                gone, left = out.pop(), tried.pop()
                at -= chars[gone] if gone >= 0 else 1
        if -1 not in out:
            return out
        found, at = [], 0
        for n in out:
            if n < 0:
                found.extend(self.byte_id[b] for b in text[at].encode())
            else:
                found.append(n)
            at += chars[n] if n >= 0 else 1
        return found

    def part_ids(self, text: str) -> list[int]:
        """The ids of a part that no merge leaves."""
        found = self.parts.get(text)
        if found is None:
            found = self.backtracked(text)
            if (cost := OVERHEAD + 4 * len(text) + 36 * len(found)) < KEPT_BYTES // 64:
                if (held := self.held + cost) > KEPT_BYTES:
                    self.parts, held = {}, cost
                self.parts[text], self.held = found, held
        return found

    def chunk_ids(self, text: str) -> list[int]:
        joined = self.joined
        cuts = [i for i, pair in enumerate(zip(text, text[1:], strict=False), 1) if pair not in joined]
        return [n for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True) for n in self.part_ids(text[i:j])]

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` for many pairs: a table of the pairs met, each at the place of its hash."""
        pair = left << 32 | right
        place = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        missed = np.flatnonzero(self.pair_at[place] != pair)
        if len(missed):
            new, first = np.unique(pair[missed], return_index=True)
            at = place[missed[first]]
            known = np.array([self.fits(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()], dtype=bool)
            fits = np.empty(len(pair), dtype=bool)
            hit = np.ones(len(pair), dtype=bool)
            hit[missed] = False
            fits[hit] = self.pair_fits[place[hit]]
            fits[missed] = known[np.searchsorted(new, pair[missed])]
            self.pair_at[at], self.pair_fits[at] = -1, False
            self.pair_at[at], self.pair_fits[at] = new, known
            clash = self.pair_at[at] != new  # two new pairs at one place: the one that lies there keeps its own value
            self.pair_at[at[clash]] = -1
            return fits
        return self.pair_fits[place]

    def _in_step(self, text: str, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backtracking of many short chunks at once, one choice of each at a time.

        ``text`` holds the chunks, from ``begin`` to ``end``. Returns the piece chosen at each position, and which chunks are
        encoded; those that take more than STEPS are left to ``chunk_ids``.
        """
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        start = found[:, 0] + 1 - self.chars[found[:, 1]]
        inside = np.repeat(np.arange(len(begin)), end - begin)
        own = inside[start] == inside[found[:, 0]]
        single, at = self._single(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"))
        start, choice = np.r_[at, start[own]], np.r_[single, found[own, 1]]
        del found, own
        without = np.bincount(start, minlength=len(text)) == 0  # characters without a piece: 0, after which nothing merges
        start, choice = np.r_[start, np.flatnonzero(without)], np.r_[choice, np.zeros(int(without.sum()), dtype=np.int64)]
        order = np.argsort(start, kind="stable")  # ends come in order, so shorter pieces lie first
        choice = choice[order]
        first = np.searchsorted(start[order], np.arange(len(text) + 1))
        left = np.diff(first)
        dead = np.zeros(len(text) + 1, dtype=bool)
        chosen = np.zeros(len(text) + 1, dtype=np.int64)
        back = np.full(len(text) + 1, -1)
        solved = np.zeros(len(begin), dtype=bool)
        chunk, at, before = np.arange(len(begin)), begin.copy(), np.zeros(len(begin), dtype=np.int64)
        for _ in range(STEPS):
            if not len(chunk):
                break
            tried = left[at] > 0
            # nothing left to try: the position is dead, and the piece before is taken back
            if not tried.all():
                spent = ~tried
                dead[at[spent]] = True
                from_ = back[at[spent]]
                at[spent] = from_
                earlier = np.where(from_ >= 0, back[from_], -1)
                same = (earlier >= 0) & (from_ > begin[chunk[spent]])
                before[spent] = np.where(same, chosen[earlier], 0)
                lost = at < 0
                if lost.any():
                    chunk, at, before, tried = chunk[~lost], at[~lost], before[~lost], tried[~lost]
            here = at[tried]
            left[here] -= 1
            piece = choice[first[here] + left[here]]
            onward = here + self.step[piece]
            ok = ~dead[onward]
            ok[ok] = (piece[ok] == 0) | self._fit(before[tried][ok], piece[ok])
            moved = np.flatnonzero(tried)[ok]
            here, piece, onward = here[ok], piece[ok], onward[ok]
            chosen[here] = piece
            ends = onward == end[chunk[moved]]
            solved[chunk[moved[ends]]] = True
            back[onward[~ends]] = here[~ends]
            onward_ = onward[~ends]
            left[onward_] = first[onward_ + 1] - first[onward_]
            at[moved], before[moved] = onward, piece
            if ends.any():
                rest = np.ones(len(chunk), dtype=bool)
                rest[moved[ends]] = False
                chunk, at, before = chunk[rest], at[rest], before[rest]
        return chosen, solved

    def _distinct(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks (spaces marked), one after the other, and the number of each chunk's."""
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        short = np.flatnonzero(size <= SHORT)
        text = "".join(chunks if len(short) == len(chunks) else [chunks[n] for n in short.tolist()])
        end = np.cumsum(size[short])
        begin = end - size[short]
        chosen, solved = self._in_step(text, begin, end)
        chars, char = np.unique(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), return_inverse=True)
        in_bytes = [[self.byte_id[b] for b in chr(c).encode()] for c in chars.tolist()]
        width = np.array([len(x) for x in in_bytes], dtype=np.int64)
        # the paths of all chunks, a piece at a time
        count = np.zeros(len(chunks), dtype=np.int64)
        of, at, goal = short[solved], begin[solved], end[solved]
        number = np.zeros(len(of), dtype=np.int64)
        alive, steps = np.arange(len(of)), []
        while len(alive):
            here = at[alive]
            piece = chosen[here]
            steps.append((of[alive], number[alive], piece, char[here]))
            at[alive] += self.step[piece]
            number[alive] += np.where(piece > 0, 1, width[char[here]])
            alive = alive[at[alive] < goal[alive]]
        count[of] = number
        failed = np.ones(len(chunks), dtype=bool)
        failed[of] = False
        again = np.flatnonzero(failed)
        own = [self.chunk_ids(chunks[n]) for n in again.tolist()]
        count[again] = [len(x) for x in own]
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int64)
        padded = np.array([[*x, *[0] * (4 - len(x))] for x in in_bytes], dtype=np.int64).reshape(-1, 4)
        for n, k, piece, own_char in steps:
            place = start[n] + k
            out[place[piece > 0]] = piece[piece > 0]
            if not piece.all():
                place, own_char = place[piece == 0], own_char[piece == 0]
                for j in range(4):
                    more = width[own_char] > j
                    out[place[more] + j] = padded[own_char[more], j]
        out[ranges(start[again], count[again])] = np.fromiter(chain.from_iterable(own), dtype=np.int64)
        return out, count

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, begin and end included, one after the other, and the number of each text's."""
        plain, heads, parts_of = [], [], []
        for text in texts:
            text = text.replace(SPACE, " ")
            head = ""
            if not self.prefix and text:
                at = text.find(" ")
                head, text = (text, "") if at < 0 else (text[:at], text[at + 1 :])
                parts = cut(text) if at >= 0 else []
            else:
                parts = cut(text) if text else []
            heads.append([self.begin, *(self.chunk_ids(head) if head else [])])
            parts_of.append(len(parts))
            plain.extend([p[1:] if n else p for n, p in enumerate(parts)])
        words = words_of(plain, lambda t: "  " in t or t[:1] == " " or t[-1:] == " ", _chunks)
        own, count = self._distinct([SPACE + w.replace(" ", SPACE) for w in words.distinct])
        start = np.cumsum(count) - count
        of_word = count[words.number]
        body = own[ranges(start[words.number], of_word)]
        words_before = words.before[np.r_[0, np.cumsum(parts_of)].astype(np.int64)]
        sizes = np.diff(np.r_[0, np.cumsum(of_word)][words_before])
        head_size = np.array([len(h) for h in heads], dtype=np.int64)
        total = head_size + sizes + 1
        before = np.cumsum(total) - total
        out = np.empty(int(total.sum()), dtype=np.int64)
        out[ranges(before, head_size)] = np.fromiter(chain.from_iterable(heads), dtype=np.int64)
        out[ranges(before + head_size, sizes)] = body
        out[before + total - 1] = self.end
        return out, total

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The bytes of texts whose ids lie one after the other, ``count`` of each. The first space mark goes."""
        raw = b"".join(
            self.flat[ranges(self.place[part], self.size[part])].tobytes()
            for part in (ids[at : at + DECODED_AT_ONCE] for at in range(0, len(ids), DECODED_AT_ONCE))
        )
        places = np.r_[0, np.cumsum(self.size[ids])][np.r_[0, np.cumsum(count)]].tolist()
        own = [raw[a:b] for a, b in zip(places, places[1:], strict=False)]
        return [x[1:] if x[:1] == b" " else x for x in own] if self.prefix else own

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; bytes that are no UTF-8 become U+FFFD, and the first space mark goes."""
        return self.decode_all(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


def _chunks(text: str) -> list[str]:
    """What follows the space that begins each chunk of a space and ``text``."""
    return [c[1:] for c in re.findall(" +[^ ]*", " " + text)]


@cache
def codec(path: str) -> PieceCodec:
    """One per Python worker and model."""
    return PieceCodec(path)


def encode_texts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """(doc_id, n_tokens, [ids binary, decoded string,] ids_sha256, decoded_sha256) for each row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    more = "ids binary, decoded string, " if with_ids else ""
    schema = f"doc_id {id_type}, n_tokens long, {more}ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for whole in batches:
            at = 0
            for column in slices(whole.column(1)):
                batch = whole.slice(at, len(column))
                at += len(column)
                ids, sizes = tool.encode_all([t or "" for t in column.to_pylist()])
                texts = tool.decode_all(ids, sizes)
                raw = ids.astype("<u4").tobytes()
                places = (4 * np.r_[0, np.cumsum(sizes)]).tolist()
                raws = [raw[a:b] for a, b in zip(places, places[1:], strict=False)]
                columns = {"doc_id": batch.column(0), "n_tokens": pa.array(sizes, pa.int64())}
                if with_ids:
                    columns |= {
                        "ids": pa.array(raws, pa.binary()),
                        "decoded": pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
                    }
                columns |= {
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in raws], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
