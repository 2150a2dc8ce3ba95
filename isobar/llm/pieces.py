"""SentencePiece encoding and decoding by Aho-Corasick and Viterbi.

A text's blanks become U+2581 and one is put before it, as the model file's
identity normaliser with a dummy prefix does.  It is cut before every U+2581
that follows another character, and at the control characters that no piece
has: no piece crosses these borders.  An Aho-Corasick automaton over all pieces
then runs once over a segment; at each position the matches that end there (the
output links, longest first) relax the best score of a way to it.

For BPE models the sum of scores alone is not what merging gives.  There a link
is open only if merging would leave its piece and the last piece of the way
before it apart: the merge of their joined text must give back just those two, a
test whose answers are kept.  A sequence in which every adjacent pair passes is
the merge result, so that the ids are those of the public library.  Where no way
is open to a segment's end, its pairs are merged outright (``outright`` counts
such segments; none of the texts tested has one).

Characters without a piece become their UTF-8 bytes' pieces, or the unknown
piece in models without those.

Segments' results are kept in a bounded cache for each task.  The model file is
read on the driver, and its pieces (32,000 here) go to the tasks as a broadcast.

Defined results: null texts are empty and give no ids; decoding gives the text
back, U+2581 itself excepted, which comes back as a blank.  Rows that repeat are
each encoded.  Of ways with equal sums the one found first stays, which ends in
the longer piece.  Texts of any length are encoded whole; memory grows with a
text's segments, and segments of over ``CACHE_CHARS`` characters aren't kept.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.text import batches, table

#: Folder of the public vocabulary files, and the model in it.
TOKENIZERS, MODEL = os.environ.get("ISOBAR_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model"
#: Segments that a task keeps, those up to so many characters, and pairs.
CACHE, CACHE_CHARS, PAIRS = 200_000, 48, 300_000
BLANK = "▁"


class _Kept(dict):
    """Answers by key; one that isn't there is made.

    At most ``most`` are kept, in two halves: when the newer is full it takes the
    place of the older, and what is asked for of the older moves to the newer.
    longest: longer keys (texts) aren't kept.
    """

    def __init__(self, make: Callable, most: int, longest: int | None = None):
        super().__init__()
        self.make, self.half, self.longest, self.older = make, most // 2, longest, {}

    def __missing__(self, key):
        if (found := self.older.pop(key, None)) is None:
            found = self.make(key)
            if self.longest is not None and len(key) > self.longest:
                return found
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def _cut(pieces: Iterable[str]) -> re.Pattern:
    """Finds the segments of a text, in which blanks may still stand for U+2581.

    Control characters that no piece has are segments of their own.  Letters and
    digits are parted from other characters, except those that a piece has beside
    one of the other kind: they count as of the other kind.
    """
    borders = re.escape("".join(c for c in map(chr, range(32)) if not any(c in p for p in pieces)))
    beside = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False) if BLANK not in (a, b)}
    beside |= {(b, a) for a, b in beside}
    words = {c for pair in beside for c in pair if c.isalnum()}
    moved: set[str] = set()
    while more := {a for a, b in beside if a in words and b not in words}:
        moved |= more
        words -= more
    odd = re.escape("".join(sorted(moved)))
    runs = [rf"[^\W_{odd}]++", rf"(?:[^\w {BLANK}{borders}]|[_{odd}])++"]
    return re.compile("|".join([*(f"[ {BLANK}]*+{x}" for x in runs), f"[ {BLANK}]+", *([f"[{borders}]"] if borders else [])]))


@dataclass
class Pieces:
    """A model's pieces and scores, with encoding and decoding."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    control: frozenset
    unknown: int
    bpe: bool
    outright: int = 0
    _made: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=path)
        n = held.get_piece_size()
        names = [held.id_to_piece(i) for i in range(n)]
        scores = [held.get_score(i) for i in range(n)]
        byte_ids = [-1] * 256
        control = set()
        for i in range(n):
            if held.is_byte(i):
                byte_ids[int(names[i][3:5], 16)] = i
            if held.is_byte(i) or held.is_control(i) or held.is_unknown(i) or held.is_unused(i):
                control.add(i)
        # In BPE models the scores of learned pieces are whole numbers, one less for each.
        plain = [scores[i] for i in range(n) if i not in control]
        return cls(names, scores, byte_ids if byte_ids[0] >= 0 else [], frozenset(control), held.unk_id(), all(x == int(x) for x in plain))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"} | {"_made": {}}

    def _automaton(self):
        if "automaton" not in self._made:
            import ahocorasick

            ids = {p: i for i, p in enumerate(self.pieces) if i not in self.control and p}
            low = min((self.scores[i] for i in ids.values()), default=0.0) - 10
            alphabet = {p for p in ids if len(p) == 1}
            self._made |= {"ids": ids, "splits": {}, "automaton": None, "cut": _cut(ids), "low": low, "alphabet": alphabet}
            if self.bpe:
                self._number()
            self._made |= {"pairs": _Kept(self._apart, PAIRS), "cache": _Kept(self._packed, CACHE, CACHE_CHARS)}
            held = ahocorasick.Automaton()
            for piece, i in ids.items():
                # A BPE piece that merging doesn't make out of its own text is in no result.
                if not self.bpe or len(piece) == 1 or self._split(piece) is not None:
                    held.add_word(piece, (i, len(piece), self.scores[i]))
            held.make_automaton()
            self._made["automaton"] = held
        return self._made["automaton"]

    # merging outright: for the pair test, and for segments without an open way

    def merged(self, segment: str, last: list | None = None) -> list[str]:
        """The segment's symbols after merging the best adjacent pair as long as there is one.

        last: gets the two symbols of the last merge.
        """
        ids, scores = self._made["ids"], self.scores
        symbol = list(segment)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := ids.get(symbol[i] + symbol[j])) is not None:
                heapq.heappush(heap, (-scores[k], i, j, symbol[i], symbol[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if symbol[i] != a or after[i] != j or symbol[j] != b:
                continue
            if last is not None:
                last[:] = a, b
            symbol[i] += symbol[j]
            symbol[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in symbol if x]

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes a piece; None if merging its text doesn't make it, or for one character."""
        known = self._made["splits"]
        if piece not in known:
            last: list[str] = []
            whole = len(piece) > 1 and self.merged(piece, last) == [piece]
            known[piece] = (last[0], last[1]) if whole else None
        return known[piece]

    def _apart(self, pair: int) -> bool:
        """Whether merging the joined text of two pieces gives back those two; pair: their ids, the first times 2**20."""
        return self._stay(pair >> 20, pair & 0xFFFFF)

    def _number(self) -> None:
        """What the pair test reads: the two symbols that merging makes each piece of, and the piece that any two make.

        Symbols are numbers: a piece's id, and further ones for characters that are no piece.
        """
        ids = self._made["ids"]
        number = ids | {c: len(self.pieces) + k for k, c in enumerate(sorted({c for p in ids for c in p} - self._made["alphabet"]))}
        parts: list[tuple[int, int] | None] = [None] * (len(self.pieces) + len(number) - len(ids))
        made: dict[int, int] = {}
        for piece, i in ids.items():
            if (found := self._split(piece)) is not None:
                parts[i] = number[found[0]], number[found[1]]
            for k in range(1, len(piece)):
                if (a := number.get(piece[:k])) is not None and (b := number.get(piece[k:])) is not None:
                    made[a << 20 | b] = i
        self._made |= {"parts": parts, "made": made}

    def _stay(self, x: int, y: int) -> bool:
        """The same for two pieces, both made by merging their own texts.

        limit: the score of the merge undone last.  Of equal scores the merge
        further left comes first: that of ``x`` before the two that meet, that of
        ``y`` after them.
        """
        parts, made, scores = self._made["parts"], self._made["made"], self.scores
        limit, left = None, False
        while True:
            if (k := made.get(x << 20 | y)) is not None and (limit is None or scores[k] > limit or scores[k] == limit and not left):
                return False
            p, q = parts[x], parts[y]
            if p is None and q is None:
                return True
            left = q is None or p is not None and scores[x] < scores[y]
            limit = scores[x if left else y]
            if left:
                x = p[1]
            else:
                y = q[0]

    def _ids_of(self, symbols: list[str]) -> list[int]:
        ids, out = self._made["ids"], []
        for x in symbols:
            if (i := ids.get(x)) is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in x.encode()]
            else:
                out.append(self.unknown)
        return out

    def segment(self, segment: str) -> list[int]:
        """Ids of one segment: the best way through it."""
        automaton = self._automaton()
        found = self._viterbi(automaton, segment)
        if found is None:
            self.outright += 1
            return self._ids_of(self.merged(segment))
        return found

    def _viterbi(self, automaton, segment: str) -> list[int] | None:
        """Ids of the way of the best sum of scores to the segment's end, or None if no way is open.

        The automaton names the pieces that end at each position, the output
        links from the longest to the shortest; each relaxes the best score
        there.  For BPE a way is open to a piece only if merging leaves that
        piece and the one before it apart.  An open way is what merging makes of
        the text up to its end, so that there is one at most: at a position that
        has one the other links are closed and aren't tested.  A character that
        is no piece is a step of its own, worse than any piece.
        """
        n, bpe, pairs = len(segment), self.bpe, self._made["pairs"]
        low, odd = self._made["low"], not self._made["alphabet"].issuperset(segment)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        last = [-1] * (n + 1)
        done = 0
        for end, (i, size, more) in automaton.iter(segment):
            end += 1
            if odd and end > done:
                self._bridge(segment, best, done, end, low)
                done = end
            held = best[end]
            if bpe and held is not None:
                continue
            if (score := best[start := end - size]) is None:
                continue
            if bpe and (a := last[start]) >= 0 and not pairs[a << 20 | i]:
                continue
            score += more
            if held is None or score > held:
                best[end], last[end] = score, i
        if odd and n > done:
            self._bridge(segment, best, done, n, low)
        if best[n] is None:
            return None
        out: list[int] = []
        while n:
            if (i := last[n]) >= 0:
                out.append(i)
                n -= len(self.pieces[i])
            else:
                out += self._ids_of([segment[n - 1]])[::-1]
                n -= 1
        out.reverse()
        return out

    def _bridge(self, segment: str, best: list, done: int, to: int, low: float) -> None:
        """Steps over characters that are no piece, from the position ``done`` to ``to``."""
        known = self._made["ids"]
        for p in range(done + 1, to + 1):
            if best[p - 1] is not None and segment[p - 1] not in known:
                best[p] = best[p - 1] + low

    def encode(self, text: str | None) -> array:
        """Ids of a whole text."""
        self._automaton()
        cache, out = self._made["cache"], array("i")
        if text:
            out.frombytes(b"".join([cache[x] for x in self._made["cut"].findall(f" {text}")]))
        return out

    def _packed(self, segment: str) -> bytes:
        return array("i", self.segment(segment.replace(" ", BLANK))).tobytes()

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, U+2581 as blanks, less the one put before."""
        if "bytes" not in self._made:
            self._made["bytes"] = [p.replace(BLANK, " ").encode() for p in self.pieces]
            for value, i in enumerate(self.byte_ids):
                self._made["bytes"][i] = bytes([value])
            for i in self.control - set(self.byte_ids):
                self._made["bytes"][i] = b""
        held = self._made["bytes"]
        return b"".join([held[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids and round_trip.

    round_trip: decoding the ids gives the text back (U+2581 as a blank).
    """
    model = Pieces.load(path or os.path.join(TOKENIZERS, MODEL))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches(rows, 2 << 20):
            lengths, back, ids = [], [], array("i")
            for text in batch.column(1).to_pylist():
                found = own.encode(text)
                back.append(own.decode(found) == (text or "").replace(BLANK, " "))
                lengths.append(len(found))
                ids += found
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(ids, np.int32) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), lists, pa.array(back, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids give an empty text."""
    model = Pieces.load(path or os.path.join(TOKENIZERS, MODEL))
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 2 << 20):
            texts = [held.value.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op9_pieces": op9_pieces}
ORACLE: dict[str, str] = {}
