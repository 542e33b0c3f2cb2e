"""SentencePiece ids by a streaming Viterbi pass, and back.

The lattice of a text is built from left to right: for every place the one best last piece is kept as a backpointer.
Only the places within the longest piece's length can still start a new piece, so as soon as the backpointer paths of
those survivors meet on one boundary, everything before it is final: its ids are committed and its backpointers are
dropped. Memory follows the window, not the text.

Two rules choose the backpointer. `unigram`: the highest sum of piece scores. `bpe`: the piece that the merge order itself
would leave at the end; a sequence is what merging yields exactly if every neighbouring pair is what merging that pair
alone yields, so one look at the piece before decides. The second gives the ids of the reference library for merge
models. Characters without a piece become byte pieces and are boundaries on their own.

No piece of such vocabularies spans a space inside or a line end, so all paths meet there: a word is a window of its own.
Words that were seen before take their ids from a bounded cache; the new ones of a slice of texts run through the
lattice side by side, as arrays.

Defined cases: null stays null, empty text has no ids; the word-start mark itself, if a text holds it, is written as
bytes so that decoding gives it back; repeated rows give repeated results; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import slices
from tickloom.llm.words import mix

#: Fixed value of the format: the mark that stands for a space.
MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose ids, and pairs whose verdicts (a power of two), a worker remembers.
CACHED_WORDS, CACHED_PAIRS = 240_000, 1 << 19
#: Longest word that is remembered, and how many places pass between looks for a meeting point.
LONGEST_CACHED, STRIDE = 64, 32

# a word with the space before it, a line end, spaces before a word's own, spaces at the end
_PARTS = re.compile(" ?[^ \n]+|\n| +(?= [^ \n])| +")
_HIDDEN = ""


@dataclass
class Vocabulary:
    """Pieces of a model: what the tasks need of it (about as many entries as the model has)."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    text_of: list[bytes]
    kind: str = "bpe"
    #: of every piece that merging forms: the symbols at its right and left end while it grows, each with its own score
    #: and the score of the merge that ends it
    right: dict[str, list[tuple[str, float, float]]] = field(default_factory=dict)
    left: dict[str, list[tuple[str, float, float]]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = MODEL, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, byte_ids, text_of = {}, {}, [0] * 256, []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                byte_ids[value] = i
                text_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                text_of.append(b"")
            else:
                ids[piece] = i
                scores[piece] = model.get_score(i)
                text_of.append(piece.replace(MARK, " ").encode())
        out = cls(ids, scores, byte_ids, text_of, kind)
        if kind == "bpe":
            out.grow()
        return out

    def merged(self, text: str, until: int = 1) -> list[str]:
        """Plain merging of a short text: the best-scored neighbouring pair first, the leftmost on ties."""
        parts = list(text)
        while len(parts) > until:
            found = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def grow(self) -> None:
        """Fill `right` and `left`, short pieces first."""
        never = float("-inf")
        for p in sorted(self.ids, key=len):
            if len(p) == 1:
                self.right[p] = self.left[p] = [(p, -never, never)]
                continue
            halves = self.merged(p, 2)
            if len(halves) == 2 and halves[0] in self.left and halves[1] in self.right:
                s = self.scores[p]
                for ends, half in ((self.right, halves[1]), (self.left, halves[0])):
                    ends[p] = [*ends[half][:-1], (*ends[half][-1][:2], s), (p, s, never)]


_POWERS = np.cumprod(np.array([1] + [0x9E3779B97F4A7C15] * 64, np.uint64))


def _characters(words: list[str], width: int) -> np.ndarray:
    """Code points of words, one row each, zeros behind the end."""
    flat = "".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, np.uint32).reshape(len(words), width)


def _prefix_hashes(chars: np.ndarray) -> np.ndarray:
    """Polynomial 64-bit hashes of all prefixes; a substring's is total[end] - total[start] * power[length]."""
    mixed = mix(chars.astype(np.uint64) + np.uint64(1))
    total = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
    for j in range(chars.shape[1]):
        total[:, j + 1] = total[:, j] * _POWERS[1] + mixed[:, j]
    return total


class Pairs:
    """Verdicts on neighbouring pieces in a hash table that whole arrays are looked up in."""

    def __init__(self, judge, width: int):
        self.judge, self.width = judge, width
        self.clear()

    def clear(self) -> None:
        self.key = np.full(2 * CACHED_PAIRS, -1, np.int64)
        self.good = np.zeros(2 * CACHED_PAIRS, bool)
        self.held = 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        """The slot that holds each key, or the free one where it belongs."""
        size = len(self.key) - 1
        slot = (mix(key.astype(np.uint64)) & np.uint64(size)).astype(np.int64)
        todo = np.flatnonzero((self.key[slot] != key) & (self.key[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & size
            todo = todo[(self.key[slot[todo]] != key[todo]) & (self.key[slot[todo]] >= 0)]
        return slot

    def fit(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow; the start and characters without a piece (the last two numbers) go with all."""
        free = before >= self.width - 2
        key = before.astype(np.int64) * self.width + piece
        slot = self._slot(key)
        new = np.unique(key[(self.key[slot] < 0) & ~free])
        if len(new):
            if self.held + len(new) > CACHED_PAIRS:
                self.clear()
            good = np.array([self.judge(*divmod(k, self.width)) for k in new.tolist()])
            left = np.arange(len(new))
            while len(left):  # of keys that want the same free slot one is placed a round
                at, first = np.unique(self._slot(new[left]), return_index=True)
                self.key[at], self.good[at] = new[left[first]], good[left[first]]
                left = np.delete(left, first)
            self.held += len(new)
            slot = self._slot(key)
        return free | self.good[slot]

    def fit_one(self, before: int, piece: int) -> bool:
        return bool(self.fit(np.array([before]), np.array([piece]))[0])


class Encoder:
    """Ids of whole texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.longest = max(map(len, vocabulary.ids), default=1)
        self.bpe = vocabulary.kind == "bpe"
        self.alone = set(vocabulary.right if self.bpe else vocabulary.ids)
        lengths: dict[str, set[int]] = {}  # of the pieces that end with these two characters
        for p in self.alone:
            if len(p) > 1:
                lengths.setdefault(p[-2:], set()).add(len(p))
        self.ends = {k: (*sorted(n, reverse=True), 1) for k, n in lengths.items()}
        self.least = min(vocabulary.scores.values(), default=0.0) - 10.0
        # words seen lately, and those of the time before; a word that is asked for again moves up
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.names = sorted(self.alone, key=len) if self.bpe else []
        self.pairs = Pairs(lambda a, b: self.fits(self.names[a], self.names[b]), len(self.names) + 2)
        self.number = {p: i for i, p in enumerate(self.names)}
        self.by_length = self._hashed()
        self.mark = vocabulary.ids.get(MARK, -1)

    def fits(self, a: str, b: str) -> bool:
        """Whether merging leaves this pair as it is: no two ends that ever stand side by side merge before one of them
        is merged into its own piece. On equal scores the left merge comes first."""
        scores, left = self.v.scores, self.v.left[b]
        return not any(
            (s := scores.get(x + y)) is not None and s > x_end and s >= y_end and x_own >= y_end and y_own > x_end
            for x, x_own, x_end in self.v.right[a] for y, y_own, y_end in left
        )

    def _hashed(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per length the hash values of the pieces in order, and their numbers in `names`."""
        out = {}
        for n in {len(p) for p in self.names}:
            numbers = np.array([i for i, p in enumerate(self.names) if len(p) == n])
            value = _prefix_hashes(_characters([self.names[i] for i in numbers], n))[:, n]
            order = np.argsort(value)
            out[n] = (value[order], numbers[order])
        return out

    def side_by_side(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words for a merge model: one lattice a row, all rows advance one place at a time."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        chars = _characters(words, width)
        total = _prefix_hashes(chars)
        start, odd = len(self.names), len(self.names) + 1  # before the first piece; a character without one
        last = np.full((len(words), width + 1), start, np.int32)
        length = np.zeros((len(words), width + 1), np.int8)
        for end in range(1, width + 1):
            rows = np.flatnonzero(size >= end)
            for n in range(1, min(self.longest, end) + 1):  # at most one piece fits, so the order is free
                if not len(rows):
                    break
                if n not in self.by_length:
                    continue
                values, numbers = self.by_length[n]
                own = total[rows, end] - total[rows, end - n] * _POWERS[n]
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                hit = np.flatnonzero(values[at] == own)
                if not len(hit):
                    continue
                piece = numbers[at[hit]]
                good = self.pairs.fit(last[rows[hit], end - n], piece)
                done = hit[good]
                last[rows[done], end] = piece[good]
                length[rows[done], end] = n
                rows = np.delete(rows, done)
            last[rows, end] = odd
            length[rows, end] = 1
        # back along the pointers, all rows at once
        steps = []
        at = size.copy()
        rows = np.arange(len(words))
        while len(rows):
            steps.append((rows, last[rows, at[rows]], at[rows]))
            at[rows] -= length[rows, at[rows]]
            rows = rows[at[rows] > 0]
        row = np.concatenate([s[0] for s in steps])
        number = np.concatenate([s[1] for s in steps])
        place = np.concatenate([s[2] for s in steps])
        order = np.lexsort((place, row))
        row, number, place = row[order], number[order], place[order]
        ids = np.append(np.array([self.v.ids[p] for p in self.names], np.int64), [-1, -1])[number]
        ends = np.searchsorted(row, np.arange(len(words) + 1))
        plain = np.ones(len(words), bool)
        plain[row[ids < 0]] = False
        flat = ids.tolist()
        out = []
        for w in range(len(words)):
            a, b = ends[w], ends[w + 1]
            if plain[w]:
                out.append(tuple(flat[a:b]))
            else:
                found = [i if i >= 0 else words[w][p - 1] for i, p in zip(flat[a:b], place[a:b].tolist(), strict=True)]
                out.append(tuple(x for f in found for x in (self._ids([f]) if isinstance(f, str) else (f,))))
        return out

    def learn(self, parts: set[str]) -> None:
        """Take new words into the cache."""
        new = []
        for p in parts:
            known = self.older.get(p)
            if known is not None:
                self.words[p] = known
            elif len(p) > LONGEST_CACHED or not self.bpe:
                self.word(p)
            elif p[0] != " " or p[-1] != " ":
                new.append(p)
        new.sort(key=len)
        for i in range(0, len(new), 8192):
            some = new[i : i + 8192]
            self.words.update(zip(some, self.side_by_side([p.replace(" ", MARK) for p in some]), strict=True))

    def committed(self, text: str) -> Iterator[str]:
        """Pieces of a text without spaces inside, as they become final."""
        # back[place] = (start of the last piece, score, last piece); places at or before `base` are final
        back: dict[int, tuple[int, float, str]] = {0: (0, 0.0, "")}
        base = 0
        alone, scores = self.alone, self.v.scores
        ends, bpe, one, number = self.ends, self.bpe, (1,), self.number
        for end in range(1, len(text) + 1):
            best = None
            for n in ends.get(text[end - 2 : end], one) if end > 1 else one:
                at = back.get(end - n) if end - n >= base else None
                if at is None:
                    continue
                piece = text[end - n : end]
                if piece in alone:
                    if bpe:
                        if not at[2] or at[2] not in alone or self.pairs.fit_one(number[at[2]], number[piece]):
                            best = (end - n, 0.0, piece)
                            break
                    elif best is None or at[1] + scores[piece] > best[1]:
                        best = (end - n, at[1] + scores[piece], piece)
                elif n == 1 and best is None and piece not in scores:
                    best = (end - n, at[1] + self.least, piece)
            if best is not None:
                back[end] = best
            if end % STRIDE == 0 and end < len(text):
                meet = self._meeting(back, base, end)
                if meet > base:
                    yield from self._path(back, base, meet)
                    for k in [k for k in back if k < meet]:
                        del back[k]
                    base = meet
        yield from self._path(back, base, len(text))

    def _meeting(self, back, base: int, end: int) -> int:
        """The last boundary that the paths of all survivors share."""
        live = {k for k in range(max(base, end - self.longest + 1), end + 1) if k in back}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(back[top][0] if top > base else base)
        return live.pop()

    @staticmethod
    def _path(back, base: int, end: int) -> list[str]:
        out = []
        while end > base:
            out.append(back[end][2])
            end = back[end][0]
        return out[::-1]

    def _ids(self, pieces) -> list[int]:
        out, ids = [], self.v.ids
        for p in pieces:
            i = ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [self.v.byte_ids[b] for b in (MARK if p == _HIDDEN else p).encode("utf-8", "surrogatepass")]
        return out

    def word(self, part: str) -> tuple[int, ...]:
        """Ids of one word with or without the space before it; long ones are not remembered."""
        known = self.words.get(part)
        if known is None:
            text = part.replace(" ", MARK)
            known = self.side_by_side([text])[0] if self.bpe and len(part) <= LONGEST_CACHED else tuple(self._ids(self.committed(text)))
            if len(part) <= LONGEST_CACHED:
                self.words[part] = known
        return known

    def spaces(self, n: int) -> list[int]:
        """Ids of n spaces; whole pieces of the longest size first, so a long run stays cheap."""
        sizes = [k for k in range(2, self.longest + 1) if MARK * k in self.v.ids]
        top = max(sizes, default=1)
        whole = max(0, n // top - 2) if self.bpe else 0
        rest = n - whole * top
        pieces = self.v.merged(MARK * rest) if self.bpe else list(self.committed(MARK * rest))
        return [self.v.ids[MARK * top]] * whole + self._ids(pieces)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; the words they have in common are looked up once."""
        if len(self.words) >= CACHED_WORDS // 2:
            self.older, self.words = self.words, {}
        spaced = [" " + (t.replace(MARK, _HIDDEN) if MARK in t and _HIDDEN not in t else t) if t else "" for t in texts]
        parts = [_PARTS.findall(t) for t in spaced]
        self.learn({p for found in parts for p in found if len(p) <= LONGEST_CACHED}.difference(self.words))
        return [self._joined(t, found) for t, found in zip(spaced, parts, strict=True)]

    def _joined(self, text: str, parts: list[str]) -> list[int]:
        words = self.words
        if "  " not in text and text[-1:] != " ":
            try:
                return list(chain.from_iterable(map(words.__getitem__, parts)))
            except KeyError:  # a word too long to be remembered
                pass
        out: list[int] = []
        free = 0
        for part in parts:
            if part[0] == " " and part[-1] == " ":
                free = len(part)  # the next word's own space may turn out to belong to them
                continue
            found = words.get(part) or self.word(part)
            if free:
                if found[0] == self.mark and part[0] == " ":
                    free, found = free + 1, found[1:]
                out += self.spaces(free)
                free = 0
            out += found
        if free:
            out += self.spaces(free)
        return out


def decode(ids: list[int], text_of: list[bytes]) -> str:
    """The text of ids."""
    out = b"".join(map(text_of.__getitem__, ids)).decode("utf-8", "replace")
    return out[1:] if out[:1] == " " else out


_encoder: Encoder | None = None


def _encoder_of(vocabulary: Vocabulary) -> Encoder:
    """This worker's encoder; its caches live as long as the worker keeps the vocabulary."""
    global _encoder
    if _encoder is None or _encoder.v is not vocabulary:
        _encoder = Encoder(vocabulary)
    return _encoder


def encoded(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    """Column struct<ids: array<int>, exact: boolean> of a text column: its ids, and whether they decode to it.

    Both come from one pass: as two columns the ids would be worked out twice.
    """
    held = spark.sparkContext.broadcast(vocabulary)

    def run(column: pa.Array) -> pa.Array:
        encoder = _encoder_of(held.value)
        found, sizes, exact, none = [np.zeros(0, np.int32)], [], [], []
        for part in slices(pa.RecordBatch.from_arrays([column], names=["t"]), "t"):
            texts = part.column(0).to_pylist()
            for text, ids in zip(texts, encoder.encode_all([t or "" for t in texts]), strict=True):
                none.append(text is None)
                sizes.append(len(ids))
                found.append(np.array(ids, np.int32))
                exact.append(None if text is None else decode(ids, held.value.text_of) == text)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32(), mask=np.array([*none, False]))
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found), pa.int32()))
        return pa.StructArray.from_arrays([ids, pa.array(exact, pa.bool_())], names=["ids", "exact"])

    return F.arrow_udf(run, "struct<ids:array<int>,exact:boolean>")(text)


def decoded(spark: SparkSession, ids: Column, vocabulary: Vocabulary) -> Column:
    """Column of texts of an ids column."""
    held = spark.sparkContext.broadcast(vocabulary.text_of)

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x.as_py() is None else decode(x.as_py(), held.value) for x in column], pa.string())

    return F.arrow_udf(run, "string")(ids)
