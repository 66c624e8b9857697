"""Token counts of whole texts by a finite-state transducer compiled from a BPE vocabulary of pieces.

1. *States.* What a vocabulary's merges make of a text is a sequence of pieces, and what they make of its first ``i``
   characters has one last piece for each ``i``. A piece may follow another if the merges leave the two as they are
   when they get them alone; a sequence is what the merges give exactly when this holds for all neighbours. So the last
   piece at a place follows from the last pieces at the places before it where a piece may still begin. A state is the
   list of those: for each suffix of what was read that begins some longer piece, the piece before it and how many
   tokens fewer there were then.
2. *Transitions* read a character and carry how many tokens more, or fewer, the text has with it: characters that join
   their neighbours take tokens away. They are compiled when a text first asks for them and stay with the worker
   process, in a hash table of bounded size that is emptied when it is full.
3. *Barriers.* Where no piece holds two characters side by side, nothing of what came before counts: the state is the
   initial one. Characters that no piece holds are such places on both sides and count one token a byte.
4. *Chunks.* The texts of a batch are cut into chunks of some hundred characters, at barriers where there are any. All
   chunks are read at a time, a character of each in a step. A chunk that begins at a barrier has one state to start
   from. In a stretch without barriers a chunk can begin in several: those that hold if a piece ends at one of the
   places before it. It is read from each of them, which gives its map from states to states and counts; the maps are
   composed by a parallel prefix scan of as many steps as the logarithm of their number. A state that no map foresaw is
   read anew from where it occurs.

A null text counts as empty and has no token. Texts of any length are read whole; repeated rows and ids are counted row
by row, a missing id is carried. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailtriage.llm.tables import slices, texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "piece_bpe_32k.model"
LIMIT = 4096  # tokens
CHUNK = 256  # characters
BEFORE = 32  # characters read ahead of a chunk to find the states it can begin in
SPACE = "▁"  # what the vocabulary writes for a space
SYMBOL_BITS = 16
SLOTS = 1 << 22
MOST_STATES = 1 << 19
_MIX = np.int64(-7046029254386353131)  # odd; spreads keys over the slots

State = tuple[tuple[int, str, int], ...]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Pieces:
    """The pieces that merges can make, with their scores, and the tree of their beginnings."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.score = {model.id_to_piece(i): model.get_score(i) for i in own}
        self.longest = max(map(len, self.score))
        self.child: dict[tuple[int, str], int] = {}
        self.piece: list[str | None] = [None]
        self.inner: list[bool] = [False]  # whether a longer piece goes on from here
        for piece in self.score:
            at = 0
            for c in piece:
                self.inner[at] = True
                if (at, c) not in self.child:
                    self.child[at, c] = len(self.piece)
                    self.piece.append(None)
                    self.inner.append(False)
                at = self.child[at, c]
            self.piece[at] = piece
        self.follows: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best merge first, the leftmost of equal ones."""
        parts = list(text)
        while True:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores, default=-np.inf)
            if best == -np.inf:
                return parts
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, before: str, piece: str) -> bool:
        """Whether the merges leave the two side by side; nothing before leaves the piece alone."""
        known = self.follows.get((before, piece))
        if known is None:
            known = self.merged(before + piece) == ([before, piece] if before else [piece])
            self.follows[before, piece] = known
        return known


class Transducer:
    """The transitions met so far, by state and symbol; symbols number the characters of the vocabulary, and above them
    others by their length in bytes."""

    INITIAL: State = ((0, "", 0),)

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.characters = sorted({c for piece in self.pieces.score for c in piece})
        n = len(self.characters)
        self.symbol = np.full(0x110000, n + 4, np.int32)
        self.symbol[:0x10000], self.symbol[:0x800], self.symbol[:0x80] = n + 3, n + 2, n + 1
        self.symbol[[ord(c) for c in self.characters]] = np.arange(1, n + 1)
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        sides = {(a, b) for piece in self.pieces.score for a, b in zip(piece, piece[1:], strict=False)}
        keys = [int(self.symbol[ord(a)]) << SYMBOL_BITS | int(self.symbol[ord(b)]) for a, b in sides]
        self.joined = np.sort(np.array(keys or [0], np.int64))
        self.forget()

    def forget(self) -> None:
        self.states: list[State] = [self.INITIAL]
        self.number: dict[State, int] = {self.INITIAL: 0}
        self.keys = np.full(SLOTS, -1, np.int64)
        self.next = np.zeros(SLOTS, np.int32)
        self.gain = np.zeros(SLOTS, np.int32)
        self.held = 0
        self.pieces.follows.clear()

    def transition(self, state: State, symbol: int) -> tuple[State, int]:
        """The state after the symbol, and the tokens that it adds."""
        if symbol > len(self.characters):
            return self.INITIAL, symbol - len(self.characters)
        c, p = self.characters[symbol - 1], self.pieces
        last, gain, still = None, 0, []
        for node, before, fewer in state:
            node = p.child.get((node, c))
            if node is None:
                continue
            piece = p.piece[node]
            if last is None and piece is not None and p.may_follow(before, piece):
                last, gain = piece, 1 - fewer
            if p.inner[node]:
                still.append((node, before, fewer))
        if last is None:
            raise ValueError(f"the vocabulary has no piece for {c!r} by itself")
        return (*((node, before, fewer + gain) for node, before, fewer in still), (0, last, 0)), gain

    def _learn(self, key: int) -> None:
        state, gain = self.transition(self.states[key >> SYMBOL_BITS], key & (1 << SYMBOL_BITS) - 1)
        number = self.number.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        at = int(self._slots(np.array([key]))[0])
        while self.keys[at] != -1:
            at = (at + 1) % SLOTS
        self.keys[at], self.next[at], self.gain[at] = key, number, gain
        self.held += 1

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX >> np.int64(40)) & np.int64(SLOTS - 1)

    def full(self) -> bool:
        return 2 * self.held > SLOTS or len(self.states) > MOST_STATES

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of every lane."""
        keys = states << np.int64(SYMBOL_BITS) | symbols
        at = self._slots(keys)
        open_ = np.flatnonzero(self.keys[at] != keys)
        while len(open_):
            here = self.keys[at[open_]]
            if (here == -1).any():
                for key in np.unique(keys[open_[here == -1]]).tolist():
                    self._learn(key)
                here = self.keys[at[open_]]
            open_ = open_[here != keys[open_]]
            at[open_] = (at[open_] + 1) % SLOTS
            open_ = open_[self.keys[at[open_]] != keys[open_]]
        return self.next[at].astype(np.int64), self.gain[at]

    def read(self, text: np.ndarray, barrier: np.ndarray, start: np.ndarray, end: np.ndarray, states: np.ndarray) -> tuple:
        """The states after, and the tokens added by, the stretches of ``text`` read from the given states."""
        order = np.argsort(start - end, kind="stable")  # the longest first: those still being read are the first ones
        at, left, state = start[order], (end - start)[order], states[order].astype(np.int64)
        added = np.zeros(len(order), np.int64)
        alive = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
        for n in alive.tolist():
            place = at[:n]
            state[:n], gain = self.advance(np.where(barrier[place], 0, state[:n]), text[place])
            added[:n] += gain
            at[:n] += 1
        ends, gains = np.empty_like(state), np.empty_like(added)
        ends[order], gains[order] = state, added
        return ends, gains

    def count(self, raw: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        if self.full():
            self.forget()
        text, first = self._symbols(raw)
        counts = np.zeros(len(raw), np.int64)
        if not len(text):
            return counts
        barrier = np.ones(len(text), bool)
        pairs = text[:-1].astype(np.int64) << np.int64(SYMBOL_BITS) | text[1:]
        barrier[1:] = self.joined[np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)] != pairs
        barrier[first[first < len(text)]] = True
        places = np.flatnonzero(barrier)
        cuts = places[np.minimum(np.searchsorted(places, np.arange(0, len(text), CHUNK)), len(places) - 1)]
        cuts = np.unique(np.concatenate([cuts, first[first < len(text)]]))
        lengths = np.diff(np.append(cuts, len(text)))
        n_soft = np.maximum(0, lengths // CHUNK - 1)  # further chunks of a stretch without barriers
        chain = np.repeat(np.arange(len(cuts)), n_soft + 1)
        place = np.arange(len(chain)) - np.repeat(np.cumsum(n_soft + 1) - n_soft - 1, n_soft + 1)
        start = cuts[chain] + place * CHUNK
        end = np.append(start[1:], len(text))
        hard = np.flatnonzero(place == 0)
        ends, gains = self.read(text, barrier, start[hard], end[hard], np.zeros(len(hard), np.int64))
        long = np.flatnonzero(n_soft > 0)
        if len(long):
            gains[long] = self._chains(text, barrier, start, end, chain, place, hard, ends, gains, long)
        owner = np.searchsorted(first, cuts, side="right") - 1
        np.add.at(counts, owner, gains)
        return counts

    def _symbols(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts in a row, each that is not empty behind a space, and where each begins."""
        sizes = np.array([len(x) + 1 if x else 0 for x in raw], np.int64)
        joined = "".join([" " + x for x in raw if x])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.symbol[points], np.cumsum(sizes) - sizes

    def _chains(self, text, barrier, start, end, chain, place, hard, ends, gains, long) -> np.ndarray:
        """The tokens of the chains that have chunks without a barrier at their start: maps of chunks, composed."""
        lanes = np.flatnonzero(np.isin(chain, long))
        soft = place[lanes] > 0
        wide = self.pieces.longest
        domain = np.zeros((len(lanes), wide), np.int64)
        image, gain = np.repeat(ends[chain[lanes], None], wide, 1), np.repeat(gains[chain[lanes], None], wide, 1)
        inner = lanes[soft]
        ahead = (start[inner, None] - BEFORE - np.arange(wide)).ravel()
        begin, _ = self.read(text, barrier, ahead, np.repeat(start[inner], wide), np.zeros(len(ahead), np.int64))
        owner = np.repeat(np.arange(len(inner)), wide)
        pairs, back = np.unique(owner << np.int64(32) | begin, return_inverse=True)  # several lead to one state
        at = inner[pairs >> np.int64(32)]
        after, added = self.read(text, barrier, start[at], end[at], pairs & np.int64(0xFFFFFFFF))
        domain[soft] = begin.reshape(-1, wide)
        image[soft], gain[soft] = after[back].reshape(-1, wide), added[back].reshape(-1, wide)
        step, where = 1, place[lanes]
        while step <= where.max():
            later = np.flatnonzero(where >= step)  # its map goes back ``step`` chunks; that of its forerunner goes before
            domain2, image2, gain2 = domain[later - step], image[later - step], gain[later - step]
            found = image2[:, :, None] == domain[later][:, None, :]
            which, known = found.argmax(2), found.any(2) & (image2 >= 0)
            to = np.where(known, np.take_along_axis(image[later], which, 1), -1)
            more = np.where(known, gain2 + np.take_along_axis(gain[later], which, 1), 0)
            known = to >= 0
            domain[later], image[later], gain[later] = domain2, to, np.where(known, more, 0)
            step *= 2
        final = np.append(np.flatnonzero(where[1:] == 0), len(lanes) - 1)
        total = gain[final, 0].copy()
        for i in np.flatnonzero(image[final, 0] < 0).tolist():  # not foreseen: the whole chain from its start
            first = hard[long[i]]
            last = first + where[final[i]]
            _, own = self.read(text, barrier, start[[first]], end[[last]], np.zeros(1, np.int64))
            total[i] = own[0]
        return total


def transducer(path: str) -> Transducer:
    """The one that the worker process keeps: later tasks find what earlier ones have compiled."""
    kept = sys.modules.setdefault("_mailtriage_transducers", types.ModuleType("_mailtriage_transducers"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Transducer(path)
    return kept.__dict__[path]


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row."""
    path = model or default_model()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = transducer(path)
        for batch in slices(batches, lambda b: b.column("text")):
            counts = counter.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"]
            )

    rows = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
