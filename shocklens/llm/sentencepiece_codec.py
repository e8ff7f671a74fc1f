"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The distinct words of a batch that are new to the worker (runs of letters or of
other characters, as no piece mixes them) are joined to one text. Its suffix array is searched for every piece of the model by binary
search; each occurrence is an edge from its first to its last character, kept
by position and length. The edges are relaxed word by word: of the edges that
span exactly two neighbouring symbols each word takes the one with the best
score, leftmost first, until none is left. That is the model's own merge order,
so the ids are those of the library. Characters that no piece covers become
their bytes.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters indexed in one go, characters of words relaxed side by side, words and ids a worker remembers.
INDEXED = 1 << 19
SIDE_BY_SIDE = 128
REMEMBERED = 400_000
REMEMBERED_IDS = 1 << 22
#: The rank of a span that is no piece.
NONE = 1 << 30
#: Characters of documents whose ids are put together in one go.
PENDING = 1 << 21


def words_of(pieces: list[str]) -> re.Pattern[str]:
    """What no piece goes beyond: words, each with the spaces before it, and if no piece mixes letters with other characters, runs of either."""
    letters = {x for piece in pieces for x in piece if x.isalpha()}
    if not letters or any((a in letters) != (b in letters) for piece in pieces for a, b in itertools.pairwise(piece.lstrip(SPACE))):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    own = "".join(sorted(letters))
    return re.compile(f"{SPACE}*[{own}]+|{SPACE}*[^{own}{SPACE}]+|{SPACE}+")


def packed(columns: Iterable[np.ndarray], bits: int) -> np.ndarray:
    """Columns of numbers of so many bits, the first one highest, as one number a row."""
    key = None
    for x in columns:
        key = x.astype(np.int64) if key is None else key << bits | x
    return key


def suffix_array(dense: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffix order by the first ``width`` numbers at least.

    The numbers, of so many bits each, are packed as many to a word as fit; one
    sort orders suffixes by that many, and sorts by the ranks of the suffixes
    that follow do the rest. Also returned are the packed words by position,
    with zeros behind the end, and how many numbers each holds.
    """
    n, step = len(dense), min(width, 62 // bits)
    key = np.zeros(n + width, np.int64)
    for i in range(step):
        key[:n] <<= bits
        key[: max(n - i, 0)] |= dense[i:]
    order = np.argsort(key[:n])
    by, reach = key[:n], step
    each = (n + 1).bit_length()
    while reach < width:
        ordered = by[order]
        rank = np.zeros(n + width, np.int64)
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        ahead = range(0, min(width, reach * (62 // each)), reach)
        by = packed((rank[k : n + k] for k in ahead), each)
        order = np.argsort(by)
        reach *= len(ahead)
    return order, key, step


def utf8_size(codes: np.ndarray) -> np.ndarray:
    """Bytes of each character."""
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


class Numbers(dict):
    """The number of each word; a word that is new gets the next one and is listed."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class Codec:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        names = [model.id_to_piece(i) for i in self.pieces]
        if any(SPACE in x.lstrip(SPACE) for x in names):
            raise ValueError("pieces that go on after a space are not supported")
        self.word = words_of(names)
        score = np.array([model.get_score(i) for i in self.pieces])
        self.longest = max(map(len, names))
        self.size = np.array([len(x) for x in names], np.int64)
        # Equal scores get equal ranks, so that of them the leftmost goes first.
        self.rank = np.r_[np.unique(-score, return_inverse=True)[1].astype(np.int64), NONE]
        self.ids = np.array(self.pieces, "<i4")
        # The characters of pieces, numbered from 1; each piece is a row of numbers, then zeros.
        letters = np.unique(np.frombuffer("".join(names).encode("utf-32-le"), np.uint32))
        self.number = np.zeros(0x110000, np.int32)
        self.number[letters] = np.arange(1, len(letters) + 1)
        self.spelled = self.number[np.array(names, f"U{self.longest}").view(np.uint32).reshape(len(names), -1)]
        of_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.of_byte = np.array([of_byte.get(b, self.unknown) for b in range(256)], "<i4") if of_byte else None
        self.shown = [b"" if model.is_control(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        if self.unknown >= 0:
            self.shown[self.unknown] = " ⁇ ".encode()
        self.shown_size = np.array([len(x) for x in self.shown], np.int64)
        self._forget()
        self._check(model, names)

    def _check(self, model: sentencepiece.SentencePieceProcessor, names: list[str]) -> None:
        """Refuses a model of another kind: of pieces not merged by score, with a normalizer, or with pieces of the user's."""
        mixed = "".join(x.replace(SPACE, " ") for x in names[:: max(1, len(names) // 1500)])
        odd = "Ｆｕｌｌ ﬁ ½ Ⅷ e\u0301 \u00a0 two  spaces   end \t\n İ ß <s> </s> <unk> <pad> "
        back = " ".join(x[::-1] for x in names[:: max(1, len(names) // 300)])
        for text in (mixed, odd, back):
            if next(self.encode(iter([text]))).tolist() != model.encode(text):
                raise ValueError("only BPE models without a normalizer and without user-defined pieces are supported")

    def _forget(self) -> None:
        self.known = Numbers()
        #: By word: where its ids begin (the last entry is where they end), and whether they decode to the word.
        self.begins, self.faithful, self.learned = np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, "<i4")

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """By position and length, flat: index of the piece that occurs there, -1 where none does."""
        width, numbers = self.longest, self.number[codes]
        seen = np.zeros(int(self.number.max()) + 1, bool)
        seen[numbers] = True
        seen[0] = False
        dense = np.cumsum(seen) * seen
        bits = max(int(dense.max()).bit_length(), 1)
        order, key, step = suffix_array(dense[numbers], bits, width)
        # Pieces with a character that the text lacks do not occur.
        piece = np.flatnonzero((dense[self.spelled] > 0).sum(1) == self.size)
        spelled = np.zeros((len(piece), -(-width // step) * step), np.int64)
        spelled[:, :width] = dense[self.spelled[piece]]
        size = self.size[piece]
        low = packed(spelled[:, :step].T, bits)
        ordered = key[order]
        first, end = np.searchsorted(ordered, low, "left"), np.searchsorted(ordered, low | self._open(size, step, bits), "right")
        for k in range(step, width, step):
            # Longer pieces: in the range of what came before, suffixes stand in the order of what follows.
            more = np.flatnonzero((size > k) & (first < end))
            low = packed(spelled[more, k : k + step].T, bits)
            high = low | self._open(size[more] - k, step, bits)
            bounds = [self._bound(key, order, k, x, first[more], end[more]) for x in (low, high + 1)]
            first[more], end[more] = bounds
        counts = end - first
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = order[np.repeat(first, counts) + within] * (width + 1) + np.repeat(size, counts)
        found = np.full(len(codes) * (width + 1), -1, np.int32)
        found[at] = np.repeat(piece, counts)
        return found

    @staticmethod
    def _open(size: np.ndarray, step: int, bits: int) -> np.ndarray:
        """Ones at the places of a packed word that a piece of so many numbers leaves open."""
        return (np.int64(1) << bits * np.maximum(step - size, 0)) - 1

    @staticmethod
    def _bound(key: np.ndarray, order: np.ndarray, ahead: int, least: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place from low to high whose suffix has ``least`` or more so many characters ahead, else high."""
        low, high = low.copy(), high.copy()
        while (going := low < high).any():
            middle = (low + high) // 2
            less = going & (key[order[np.where(going, middle, 0)] + ahead] < least)
            low = np.where(less, middle + 1, low)
            high = np.where(going & ~less, middle, high)
        return low

    def _learn(self, words: list[str]) -> None:
        # The marks around words are in no piece, so nothing spans them.
        codes = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), np.uint32)
        found = self.edges(codes)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes + 1) - sizes
        end, symbol = np.arange(1, len(codes) + 1), np.ones(len(codes), bool)
        short = sizes <= SIDE_BY_SIDE
        self._side_by_side(begins[short], sizes[short], found, end, symbol)
        for b, n in zip(begins[~short].tolist(), sizes[~short].tolist(), strict=True):
            self._one(b, n, found, end, symbol)
        symbol[begins - 1] = symbol[-1] = False
        start = np.flatnonzero(symbol)
        ids, counts = self._ids(found[start * (self.longest + 1) + end[start] - start], codes[start])
        cuts = np.r_[0, np.cumsum(counts)][np.searchsorted(start, np.r_[begins, len(codes)])]
        self.faithful = np.r_[self.faithful, self._decodes(words, ids, cuts)]
        self.begins = np.r_[self.begins, self.begins[-1] + cuts[1:]]
        self.learned = np.r_[self.learned, ids]

    def _side_by_side(self, begins: np.ndarray, sizes: np.ndarray, found: np.ndarray, end: np.ndarray, symbol: np.ndarray) -> None:
        """Merges each word in its own order: ``end`` gets the ends of symbols, ``symbol`` is cleared inside of them."""
        width, n = self.longest + 1, len(end)
        before = np.arange(-1, n - 1)
        each = n.bit_length()
        none = NONE << each

        def offers(a: np.ndarray) -> np.ndarray:
            """Rank and place of the piece that the symbol at a and the next one make."""
            size = end[end[a]] - a
            return self.rank[np.where(size < width, found[a * width + np.minimum(size, width - 1)], -1)] << each | a

        # A segment is a word that still merges, with the mark before it, which offers nothing.
        segment = sizes + 1
        place = np.repeat(begins - 1 - np.cumsum(segment) + segment, segment) + np.arange(segment.sum())
        offered, slot = offers(place), np.zeros(n, np.int64)
        slot[place] = np.arange(len(place))
        while len(segment):
            best = np.minimum.reduceat(offered, np.cumsum(segment) - segment)
            goes = best < none
            best = best[goes]
            if 4 * len(best) < 3 * len(goes):
                stay = np.repeat(goes, segment)
                place, offered, segment = place[stay], offered[stay], segment[goes]
                slot[place] = np.arange(len(place))
            if not len(best):
                break
            left = best & ((1 << each) - 1)
            gone = end[left]
            after = end[gone]
            end[left], before[after], symbol[gone] = after, left, False
            offered[slot[gone]] = none
            # Only the merged symbols and their left neighbours span something new.
            for a in (left, before[left]):
                offered[slot[a]] = offers(a)

    def _one(self, begin: int, n: int, found: np.ndarray, ends: np.ndarray, symbol: np.ndarray) -> None:
        """A long word: the same merges from a heap."""
        width = self.longest + 1
        at = np.flatnonzero(found[begin * width : (begin + n) * width] >= 0) + begin * width
        span = dict(zip(at.tolist(), found[at].tolist(), strict=True))
        end = {begin + i: begin + i + 1 for i in range(n)}
        before = {begin + i + 1: begin + i for i in range(n)}
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = end.get(a)
            c = end.get(b) if b is not None else None
            if c is not None and (p := span.get(a * width + c - a) if c - a < width else None) is not None:
                heapq.heappush(heap, (int(self.rank[p]), a, c))

        for a in range(begin, begin + n - 1):
            offer(a)
        while heap:
            _, a, c = heapq.heappop(heap)
            b = end.get(a)
            if b is None or end.get(b) != c:
                continue
            del end[b]
            end[a] = c
            before[c] = a
            offer(a)
            if a > begin:
                offer(before[a])
        start = np.fromiter(end.keys(), np.int64, len(end))
        symbol[begin : begin + n] = False
        symbol[start] = True
        ends[start] = np.fromiter(end.values(), np.int64, len(end))

    def _ids(self, index: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and how many each has; a symbol without a piece is one character."""
        bare = index < 0
        counts = np.ones(len(index), np.int64)
        ids = self.ids[index]
        if bare.any():
            rest = codes[bare]
            other = self.unknown
            if self.of_byte is not None:
                counts[bare] = utf8_size(rest)
                other = self.of_byte[np.frombuffer(rest.tobytes().decode("utf-32-le").encode(), np.uint8)]
            ids = np.repeat(ids, counts)
            ids[np.repeat(bare, counts)] = other
        return ids, counts

    def _decodes(self, words: list[str], ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Whether the ids of each word, from one cut to the next, decode to it."""
        given = "".join(words).replace(SPACE, " ")
        codes = np.frombuffer(given.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        want = np.r_[0, np.cumsum(utf8_size(codes))][np.r_[0, np.cumsum(sizes)]]
        got = np.r_[0, np.cumsum(self.shown_size[ids])][cuts]
        raw, shown = given.encode(), b"".join(map(self.shown.__getitem__, ids.tolist()))
        if raw == shown and (want == got).all():
            return np.ones(len(words), bool)
        want, got = want.tolist(), got.tolist()
        return np.array([raw[a:b] == shown[c:d] for a, b, c, d in zip(want, want[1:], got, got[1:], strict=False)], bool)

    def _settle(self, pending: list[tuple[str, list[str]]]) -> Iterator[tuple[np.ndarray, bool]]:
        if len(self.known) > REMEMBERED or len(self.learned) > REMEMBERED_IDS:
            self._forget()
        numbers = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for _, words in pending]
        new, self.known.new = self.known.new, []
        group = np.cumsum(np.fromiter((len(w) + 1 for w in new), np.int64, len(new))) // INDEXED
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(new)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                self._learn(new[a:b])
        for (text, _), k in zip(pending, numbers, strict=True):
            begin = self.begins[k]
            counts = self.begins[k + 1] - begin
            ids = self.learned[np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            yield ids, (SPACE not in text and bool(self.faithful[k].all())) or self.decode(ids) == text

    def coded(self, texts: Iterator[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """Ids of each text, as the library gives them, and whether they decode to it.

        Each distinct word is decoded once. Where all words of a text decode to
        themselves and it lacks the model's space mark, so does the text; any
        other text is decoded as a whole.
        """
        pending, size = [], 0
        for text in texts:
            pending.append((text, self.word.findall(SPACE + text.replace(" ", SPACE)) if text else []))
            size += len(text)
            if size > PENDING:
                yield from self._settle(pending)
                pending, size = [], 0
        yield from self._settle(pending)

    def encode(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """Ids of each text alone."""
        return (ids for ids, _ in self.coded(texts))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that encoding puts first."""
        whole = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return whole.removeprefix(" ")


@functools.cache
def codec(path: str) -> Codec:
    """One codec for each model and worker process."""
    return Codec(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, lossless) for every row of ``docs``.

    ``model`` is the path of a BPE model that every worker can read. Ids are
    those of the whole text, without begin or end. lossless tells whether the
    ids decode to the text itself; that fails only where a text holds the
    model's own space mark. Null and empty texts have no ids and are lossless
    (as the empty text). Repeated rows and null ids give their own rows; other
    columns are ignored.
    """
    kind = "struct<token_ids array<int>, lossless boolean>"

    @F.arrow_udf(kind)
    def coded(texts: pa.Array) -> pa.Array:
        own = codec(model)
        ends, parts, same = [0], [], []
        for ids, lossless in own.coded(t.as_py() or "" for t in texts):
            parts.append(ids)
            ends.append(ends[-1] + len(ids))
            same.append(lossless)
        values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(same, pa.bool_())], ["token_ids", "lossless"])

    done = docs.select("doc_id", coded(F.col("text").cast("string")).alias("c"))
    return done.select("doc_id", F.size("c.token_ids").cast("long").alias("n_tokens"), "c.token_ids", "c.lossless")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from rows with doc_id and token_ids; null ids decode to null."""
    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        own = codec(model)
        return pa.array((None if not x.is_valid else own.decode(np.array(x.as_py(), np.int64)) for x in ids), pa.string())

    return coded.select("doc_id", text("token_ids").alias("text"))
