"""Token counts by a compiled finite-state tokenizer.

The merge rules of a model are compiled to a deterministic transducer over bytes whose transitions are
annotated with the tokens that they emit. What it rests on: pieces are the segmentation of a text just
if each is that of its own characters and each two neighbours are that of theirs. So the last piece of
every prefix follows from the last pieces of shorter prefixes: it is the one ending there that agrees
with the last piece of the prefix before it. A state is the longest end of the prefix that begins a
piece, and for each place in it the last piece there and the count so far, relative to that at the end.
A byte leads to the state one character on (or inside one); its annotation is the change in the count,
which is zero or below where a merge takes pieces back, so that a text's annotations sum up to its tokens.
States are made as texts need them, from the rules alone, and a full table is started anew.

Texts are cut into chunks of equal length that run side by side, each from the start state, as if a unit
began there. From its first unit start on (a run of spaces, or a character that no longer piece has) that
is right whatever came before; up to there a chunk is a map from the state in which it is entered to the
state in which it ends and what it counts. A chunk's map has the states in which the one before can end,
found for all chunks at once; runs that meet go on as one, which takes some characters as a rule, so texts
without any space or mark take the same time. The maps are composed by a parallel scan.

Null and empty texts have no tokens. Repeated rows are counted each. Other columns aren't looked at.
Texts of any length take the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from portcullis.llm.common import beside, kept, texts_of
from portcullis.llm.pieces import NORMAL, SPACE, PieceModel
from portcullis.llm.sentencepiece_codec import loaded, model_bytes

#: States after which the next portion starts with an empty table, and pairs of pieces whose agreement is kept.
STATES, PAIRS = 1 << 18, 1 << 18
CHUNK = 1024
#: New entering states that all chunks are asked for that have no unit start.
FEW = 64
START = 0
LAST = 0xFF  # ends a text; in no UTF-8
#: A transition: the state it leads to, and in the lowest byte its count. They are kept by state and byte in
#: open addressing, a quarter of the slots used at most.
SHIFT, ZERO, UNSET = 8, 128, -1
HASH = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    def __init__(self, model: PieceModel):
        if model.whole:
            raise ValueError("the model's pieces go over spaces, or it has no byte fallback")
        self.model = model
        self.scores = {p: s for p, s, t in zip(model.pieces, model.scores, model.types, strict=True) if t == NORMAL}
        self.begins = {p[:i] for p in self.scores for i in range(len(p))}
        self.agreeing: dict[tuple[str, str], bool] = {}
        self.built: dict[str, tuple | None] = {}
        self.alone = np.ones(0x110000, bool)  # characters that no longer piece has
        self.alone[[ord(c) for c in self.model.joined | {" "}]] = False
        self.restart()

    def restart(self) -> None:
        """An empty table, with the start alone."""
        self.keys, self.next, self.used = np.full(1 << 16, UNSET, np.int64), np.zeros(1 << 16, np.int32), 0
        # The end of the prefix that begins a piece, the last piece and the relative count at each place of it, bytes of a character.
        first = ("", ("",), (0,), b"")
        self.states: list[tuple] = [first]
        self.numbers = {first: START}

    # The merge rules --------------------------------------------------------------------------

    def edges(self, piece: str) -> tuple[tuple, tuple] | None:
        """What a piece's last and first character are merged into, step by step, each with the score of the merge
        that takes it further; None if the rules make more than one piece of its characters."""
        if piece not in self.built:
            parts, first, last = list(piece), [], []
            while len(parts) > 1:
                best, score = 0, -np.inf
                for i in range(len(parts) - 1):
                    if (s := self.scores.get(parts[i] + parts[i + 1], -np.inf)) > score:
                        best, score = i, s
                if score == -np.inf:
                    break
                if best + 2 == len(parts):
                    last.append((parts[-1], score))
                if best == 0:
                    first.append((parts[0], score))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self.built[piece] = ((*last, (piece, -np.inf)), (*first, (piece, -np.inf))) if len(parts) == 1 else None
        return self.built[piece]

    def agrees(self, before: str, piece: str) -> bool:
        """Whether ``piece`` stays whole after ``before`` (at a unit's start: after nothing).

        The rules build both from their characters, the merge of the best score first and of equal ones the leftmost.
        A merge over their border takes place if what stands on its two sides at some time makes a piece that comes
        before what takes either side further.
        """
        if not before:
            return self.edges(piece) is not None
        if (known := self.agreeing.get(pair := (before, piece))) is not None:
            return known
        left, right, i, j, whole = self.edges(before)[0], self.edges(piece)[1], 0, 0, True
        while True:
            (x, x_next), (y, y_next) = left[i], right[j]
            if (over := self.scores.get(x + y)) is not None and over > x_next and over >= y_next:
                whole = False
                break
            if x_next == y_next == -np.inf:
                break
            if x_next >= y_next:
                i += 1
            else:
                j += 1
        if len(self.agreeing) >= PAIRS:
            self.agreeing.clear()
        self.agreeing[pair] = whole
        return whole

    def after(self, state: tuple, character: str) -> tuple[tuple, int]:
        """The state one character on, and the change in the count."""
        end, last, count, _ = state
        if character == SPACE and not end.endswith(SPACE):  # a unit starts
            end, last, count = "", ("",), (0,)
        if character != SPACE and character not in self.model.joined:
            return self.states[START], self.cost(character)
        text = end + character
        n = len(text)
        for place in range(n):
            piece = text[place:]
            if (place == n - 1 or piece in self.scores) and self.edges(piece) and self.agrees(last[place], piece):
                break
        change = count[place] + self.cost(piece)
        # The longest end that begins a piece; places from which no piece goes on don't count.
        open_ = [text[k:] in self.begins for k in range(n)]
        keep = open_.index(True) if True in open_ else n
        pieces = tuple([last[k] if open_[k] else "" for k in range(keep, n)])
        counts = tuple([count[k] - change if open_[k] else 0 for k in range(keep, n)])
        return (text[keep:], (*pieces, piece), (*counts, 0), b""), change

    def cost(self, piece: str) -> int:
        return 1 if piece in self.scores else len(piece.encode())  # bytes stand for what is no piece

    def compile(self, state: int, byte: int) -> int:
        """One transition, from the rules. Bytes that can't follow (a state may be tried where none ends in it)
        lead to the start."""
        own = self.states[state]
        partial, change = own[3] + bytes([byte]), 0
        width = 1 if partial[0] < 0x80 else 2 if partial[0] < 0xE0 else 3 if partial[0] < 0xF0 else 4
        if byte == LAST or partial[0] & 0xC0 == 0x80 or (own[3] and byte & 0xC0 != 0x80):
            to = self.states[START]
        elif len(partial) < width:
            to = (*own[:3], partial)
        else:
            to, change = self.after(own, SPACE if byte == 32 else partial.decode(errors="replace")[:1])
        if (number := self.numbers.get(to)) is None:
            number = self.numbers[to] = len(self.states)
            self.states.append(to)
        return number << SHIFT | change + ZERO

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Keep new transitions."""
        self.used += len(key)
        if 4 * self.used > len(self.keys):
            full = self.keys != UNSET
            key, value = np.concatenate([self.keys[full], key]), np.concatenate([self.next[full], value])
            size = 1 << (8 * self.used - 1).bit_length()
            self.keys, self.next = np.full(size, UNSET, np.int64), np.zeros(size, np.int32)
        slot = self.slots(key)
        while len(key):
            free = self.keys[slot] == UNSET
            self.keys[slot[free]] = key[free]
            placed = self.keys[slot] == key  # of several that want a slot, one gets it
            self.next[slot[placed]] = value[placed]
            key, value, slot = key[~placed], value[~placed], (slot[~placed] + 1) % len(self.keys)

    def slots(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * HASH >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def look_up(self, key: np.ndarray) -> np.ndarray:
        """The transitions of the keys, UNSET where there is none yet."""
        slot = self.slots(key)
        held = self.keys[slot]
        found = self.next[slot]
        open_ = np.flatnonzero(held != key)
        while len(open_):
            none = held[open_] == UNSET
            found[open_[none]] = UNSET
            open_ = open_[~none]
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            held[open_], found[open_] = self.keys[slot[open_]], self.next[slot[open_]]
            open_ = open_[held[open_] != key[open_]]
        return found

    # Running ----------------------------------------------------------------------------------

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state.astype(np.int64) << 8 | byte
        found = self.look_up(key)
        if found.min(initial=0) < 0:
            new = np.unique(key[found == UNSET])
            self.put(new, np.fromiter((self.compile(k >> 8, k & 255) for k in new.tolist()), np.int32, len(new)))
            found = self.look_up(key)
        return found >> SHIFT, (found & 255) - ZERO

    def units(self, text: str, data: np.ndarray) -> np.ndarray:
        """Which bytes a unit starts at, whatever stands before: the first space of a run, and what no longer piece
        has, as well as what follows it. ``data`` is the text's UTF-8."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        alone, space = self.alone[code], code == 32
        begins = np.ones(len(code), bool)
        begins[1:] = alone[1:] | alone[:-1] | (space[1:] & ~space[:-1])
        starts = np.zeros(len(data), bool)
        starts[np.flatnonzero((data & 0xC0) != 0x80)[begins]] = True
        return starts

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.states) > STATES:
            self.restart()
        # A zero byte stands for each text's end at first: it is a character, which the end's mark isn't.
        plain = "".join([self.model.plain(t).replace(SPACE, " ").replace("\0", "\1") + "\0" for t in texts])
        data = np.frombuffer(plain.encode(), np.uint8).copy()
        starts = self.units(plain, data)
        last = np.flatnonzero(data == 0)
        data[last] = LAST
        lanes = -(-len(data) // CHUNK)
        grid = lambda x, fill: np.ascontiguousarray(np.concatenate([x, np.full(lanes * CHUNK - len(data), fill, x.dtype)]).reshape(lanes, CHUNK).T)
        byte, new = grid(data, LAST), grid(starts, True)
        emitted, after = np.zeros((CHUNK, lanes), np.int16), np.zeros((CHUNK, lanes), np.int32)
        # The run from the start leaves out what a chunk has of a character that begins in the one before.
        inside = np.logical_and.accumulate((byte[:3] & 0xC0) == 0x80, 0)
        state = np.full(lanes, START, np.int32)
        for at in range(CHUNK):
            read = np.where(inside[at], LAST, byte[at]) if at < 3 else byte[at]
            after[at], emitted[at] = state, _ = self.step(np.where(new[at], START, state), read)
        counts = emitted.T.reshape(-1)[: len(data)].astype(np.int64)
        counts[::CHUNK] += self.compose(byte, new, after, emitted)  # up to its first unit start a chunk is of one text
        return np.add.reduceat(counts, np.concatenate([[0], last[:-1] + 1]))

    def compose(self, byte: np.ndarray, new: np.ndarray, after: np.ndarray, emitted: np.ndarray) -> np.ndarray:
        """What each chunk counts in the state that it is really entered in, less what it counts from the start.

        ``after`` and ``emitted`` tell of each chunk entered in the start. A chunk's map has an entry for each state
        in which the chunk before can end, with the state in which it ends itself and its count: all chunks grow
        theirs side by side until none ends in a state that the next one's map lacks. Few new states are given to
        all chunks in whose middle no unit begins, as they would go on from one to the next otherwise. An entry runs
        up to the first unit start, or until it meets the run from the start, and goes on as that. The maps are then
        composed pairwise, in as many steps as the logarithm of the chunks, which picks each chunk's entry.
        """
        lanes = byte.shape[1]
        heads = np.where(new.any(0), new.argmax(0), CHUNK)
        through = np.flatnonzero((heads[1:] > 0) & (heads[:-1] == CHUNK)) + 1
        # Entries: chunk and entering state as one number, sorted; the state that each leads to, and its count.
        known = np.arange(lanes, dtype=np.int64) << 32 | START
        leads, more = after[-1].astype(np.int64), np.zeros(lanes, np.int64)
        sums = None
        while True:
            open_ = (known >> 32) + 1 < lanes
            follow = (known[open_] >> 32) + 1
            wanted = np.unique((follow << 32 | leads[open_])[heads[follow] > 0])
            wanted = wanted[~np.isin(wanted, known)]
            if not len(wanted):
                break
            if len(few := np.unique(wanted & 0xFFFFFFFF)) <= FEW:
                wanted = np.union1d(wanted, (through[:, None] << 32 | few).reshape(-1))
                wanted = wanted[~np.isin(wanted, known)]
            sums = np.cumsum(emitted, 0, np.int32) if sums is None else sums
            ends, counts = self.enter(wanted >> 32, (wanted & 0xFFFFFFFF).astype(np.int32), heads, byte, after, sums)
            known, leads, more = (np.concatenate(x) for x in ((known, wanted), (leads, ends), (more, counts)))
            order = np.argsort(known)
            known, leads, more = known[order], leads[order], more[order]
        # As places among the next chunk's entries; a chunk that begins with a unit has one for all.
        lane = known >> 32
        first = np.searchsorted(lane, np.arange(lanes))
        follow = np.minimum(lane + 1, lanes - 1)
        goes = np.where(heads[follow] > 0, np.searchsorted(known, follow << 32 | leads) - first[follow], 0)
        maps = np.zeros((lanes, int(np.bincount(lane).max())), np.int64)
        maps[lane, np.arange(len(known)) - first[lane]] = goes
        step = 1
        while step < lanes:
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
            step *= 2
        return more[first + np.concatenate([[0], maps[:-1, 0]])]

    def enter(self, lane: np.ndarray, state: np.ndarray, heads: np.ndarray, byte: np.ndarray, after: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states in which chunks end that are entered in these, and what they count more than from the start."""
        ends, rows, more = after[-1, lane].astype(np.int64), np.arange(len(lane)), np.zeros(len(lane), np.int64)
        for at in range(CHUNK):
            done = rows[heads[lane[rows]] <= at]
            if len(done) and at:
                more[done] -= sums[at - 1, lane[done]]
            rows = rows[heads[lane[rows]] > at]
            if not len(rows):
                return ends, more
            own = lane[rows]
            state[rows], counts = self.step(state[rows], byte[at, own])
            more[rows] += counts
            met = state[rows] == after[at, own]
            more[rows[met]] -= sums[at, own[met]]
            rows = rows[~met]
        more[rows] -= sums[-1, lane[rows]]
        ends[rows] = state[rows]
        return ends, more


def transducer(data: bytes) -> Transducer:
    """One for each Python worker: what it compiled for a task serves the next."""
    return kept(("transducer", data), lambda: Transducer(loaded(data)))


def count(df: DataFrame, model_path: str, columns: list[str], text_column: str = "text", limit: int = 4096) -> DataFrame:
    """``columns`` of ``df``, ``n_bytes``, ``n_tokens`` and whether these are over the limit."""
    data = model_bytes(model_path)

    def work(batch: pa.RecordBatch, own: Transducer) -> dict:
        tokens = own.count(texts_of(batch, "text"))
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        return {"n_bytes": sizes, "n_tokens": tokens, "over_limit": tokens > limit}

    return beside(df, columns, text_column, "n_bytes long, n_tokens long, over_limit boolean", work, lambda: transducer(data))
