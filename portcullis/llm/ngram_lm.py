"""Language-model scoring with an Elias-Fano n-gram trie.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; an end token follows. A word is
known by its XXH64. The model has three levels, smoothed after Witten and Bell:

    p(w)       = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p(w | v)   = (1 - l(v)) c(v w) / c(v) + l(v) p(w)              l(v) = B T(v) / (B T(v) + c(v))
    p(w | u v) = (1 - l(u v)) c(u v w) / c(u v) + l(u v) p(w | v)

with T the number of different words that follow, and B = ``BACK``. A context that was never seen leaves the shorter one.

The vocabulary and the trie are files in the shared folder, written by tasks and mapped into memory
by the tasks that score. A trie shard has the words u of a hash, sorted; pointers to their successors
v and from those to w. Successors are made one non-decreasing sequence by adding the last value of the
context before, so a look-up searches the successor of (that value + v) in the context's range.
Sequences and pointers are Elias-Fano coded, ratios and l quantised to 16 bits of their logarithm.
Words u with more occurrences than a shard should hold are dealt to several shards by v.

n-grams are counted in the tasks that read, sorted and compressed there, and merged once in each
shard. Null texts count as empty (an end token alone); repeated rows count as often as they occur; a
null id is a training row. An empty training set gives every token the probability of the unknown.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import beside, fresh_path, map_texts, texts_of
from portcullis.llm.elias_fano import EliasFano
from portcullis.llm.shared_files import mapped, packed, put, unpacked

ADD = 0.1
#: How strongly contexts with many different successors leave it to the shorter context.
BACK = 4.0
END = b"\n"  # no word has white space
#: Training tokens in a trie shard, words in a vocabulary piece, about.
SHARD_TOKENS, PIECE_WORDS = 3_000_000, 4_000_000
#: Logarithms (base 10) from -LOWEST to 0 in 65535 steps.
LOWEST = 12.0
#: Different words up to which ids take 32 bits; more take 64.
NARROW = (1 << 32) - 2


def words_of(text: str) -> list[bytes]:
    found = text.encode().lower().split()
    found.append(END)
    return found


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def quantised(ratio: np.ndarray) -> np.ndarray:
    return np.round(-np.log10(ratio) * (65535 / LOWEST)).clip(0, 65535).astype("<u2")


#: What each quantised level stands for.
RESTORED = 10.0 ** (np.arange(65536) * (-LOWEST / 65535))


def restored(level: np.ndarray) -> np.ndarray:
    return RESTORED[level]


def opened(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    """A file's arrays, mapped; as plain arrays, which are quicker to index than those that know their file."""
    arrays, facts = unpacked(mapped(uri))
    return {k: x.view(np.ndarray) for k, x in arrays.items()}, facts


@dataclass
class Layout:
    """Where the model is, and the sizes that all tasks need."""

    path: str
    tokens: int
    words: int
    texts: int
    piece_starts: list[int]  # ids at which the vocabulary's pieces start
    shards: int
    shard_tokens: int  # of a word, beyond which it goes on in other shards
    wide: bool  # ids take 64 bits

    @property
    def kind(self) -> str:
        """How ids are stored."""
        return "<u8" if self.wide else "<u4"

    @property
    def outside(self) -> int:
        """The id of the context before a text, and of no successor: above all words', and above that of the unknown."""
        return 1 << 48 if self.wide else (1 << 32) - 1

    def piece_of(self, value: np.ndarray) -> np.ndarray:
        return _piece(value, max(1, len(self.piece_starts)))

    def shard_of(self, first: np.ndarray, second: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Shards by the first word; by the second too where the first has very many tokens."""
        salt = second.astype(np.uint64) % (count.astype(np.uint64) // np.uint64(self.shard_tokens) + np.uint64(1))
        mixed = (first.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + salt * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(33)) % np.uint64(self.shards)).astype(np.int64)


def _piece(value: np.ndarray, pieces: int) -> np.ndarray:
    return ((value >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)


class Vocabulary:
    """Words by hash: id and count, from the mapped pieces."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.pieces = [opened(f"{layout.path}/words-{i}")[0] for i in range(len(layout.piece_starts))]

    def look_up(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count); -1 and 0 for unknown words."""
        ids, counts = np.full(len(value), -1), np.zeros(len(value), np.int64)
        piece = self.layout.piece_of(value)
        for i, start in enumerate(self.layout.piece_starts):
            own = np.flatnonzero(piece == i)
            known = self.pieces[i]["hash"]
            if len(own) and len(known):
                at = np.minimum(np.searchsorted(known, value[own]), len(known) - 1)
                hit = known[at] == value[own]
                ids[own[hit]], counts[own[hit]] = at[hit] + start, self.pieces[i]["count"][at[hit]]
        return ids, counts

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and counts of the texts' tokens, one text after another, and the numbers of tokens."""
        words: list[bytes] = []
        lengths = []
        for text in texts:
            before = len(words)
            words += words_of(text)
            lengths.append(len(words) - before)
        distinct = dict.fromkeys(words)
        ids, counts = self.look_up(hashes(list(distinct)))
        index = dict(zip(distinct, range(len(distinct)), strict=True))
        every = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        return ids[every], counts[every], np.array(lengths)


def _by_grams(u: np.ndarray, v: np.ndarray, kind: str) -> list[np.ndarray]:
    """Keys that sort by u and v, the last one first as in ``lexsort``: one if both fit in it."""
    return [u.astype(np.uint64) << np.uint64(32) | v.astype(np.uint64)] if kind == "<u4" else [v, u]


def _contexts(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, layout: Layout):
    """For each token the ids and counts of the two before it; ``outside`` before a text, -1 before that."""
    texts, outside_id = layout.texts, layout.outside
    starts = np.cumsum(lengths) - lengths
    nth = np.arange(len(ids)) - np.repeat(starts, lengths)

    def back(values: np.ndarray, n: int, outside: int) -> np.ndarray:
        moved = np.concatenate([np.full(n, outside, values.dtype), values[:-n]])[: len(values)]
        return np.where(nth >= n, moved, outside)

    one, one_count = back(ids, 1, outside_id), back(counts, 1, texts)
    two = np.where(nth == 1, outside_id, back(ids, 2, -1))
    two_count = np.where(nth == 1, texts, back(counts, 2, 0))
    return one, one_count, np.where(nth == 0, -1, two), two_count


def train(training: DataFrame, text_column: str = "text") -> Layout:
    """Count the texts' n-grams and write vocabulary and trie to the shared folder."""
    spark = training.sparkSession
    path = fresh_path(spark, "ngrams")
    rows = training.select(F.coalesce(text_column, F.lit("")).alias("text"))

    def count(batch: pa.RecordBatch) -> dict:
        found: Counter = Counter()
        for text in texts_of(batch, "text"):
            found.update(words_of(text))
        return {"hash": hashes(list(found)).view(np.int64), "times": list(found.values())}

    words = map_texts(rows, "text", "hash long, times long", count).groupBy("hash").agg(F.sum("times").alias("times"))
    end = int(hashes([END]).view(np.int64)[0])
    words.write.parquet(f"{path}/counts")
    words = spark.read.parquet(f"{path}/counts")
    totals = words.agg(F.count("*"), F.sum("times"), F.sum(F.when(F.col("hash") == end, F.col("times")))).first()
    distinct, tokens, texts = (x or 0 for x in totals)
    pieces = -(-distinct // PIECE_WORDS)
    size = max(1, pieces)

    def write_piece(table: pa.Table) -> pa.Table:
        value = table.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(value)
        piece = int(table.column("piece")[0].as_py())
        put(f"{path}/words-{piece}", packed({"hash": value[order], "count": table.column("times").to_numpy()[order]}))
        return pa.table({"piece": [piece], "n": [len(value)]})

    # The hash's upper half as an unsigned number, spread evenly over the pieces.
    upper = F.shiftrightunsigned("hash", 32)
    split = words.withColumn("piece", F.shiftrightunsigned(upper * size, 32).cast("int"))
    sizes = {r["piece"]: r["n"] for r in split.groupBy("piece").applyInArrow(write_piece, "piece long, n long").collect()} if pieces else {}
    starts, at = [], 0
    for i in range(pieces):
        starts.append(at)
        at += sizes.get(i, 0)
        if i not in sizes:
            put(f"{path}/words-{i}", packed({"hash": np.zeros(0, np.uint64), "count": np.zeros(0, np.int64)}))
    layout = Layout(path, tokens, distinct, texts, starts, max(1, -(-tokens // SHARD_TOKENS)), SHARD_TOKENS, distinct > NARROW)

    def collect(batch: pa.RecordBatch, vocabulary: Vocabulary) -> dict:
        ids, counts, lengths = vocabulary.tokens(texts_of(batch, "text"))
        one, one_count, two, two_count = _contexts(ids, counts, lengths, layout)
        three = np.flatnonzero(two >= 0)
        last = np.cumsum(lengths) - 1  # (word before the end, end) has no successor
        u = np.concatenate([two[three], one[last]]).astype(np.uint64)
        v = np.concatenate([one[three], ids[last]]).astype(np.uint64)
        w = np.concatenate([ids[three], np.full(len(last), layout.outside)]).astype(np.uint64)
        shard = layout.shard_of(u, v, np.concatenate([two_count[three], one_count[last]]))
        order = np.lexsort((w, *_by_grams(u, v, layout.kind), shard))
        u, v, w, shard = u[order], v[order], w[order], shard[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (shard[1:] != shard[:-1])])
        first = np.flatnonzero(new)
        times = np.diff(np.concatenate([first, [len(u)]]))
        squeeze = zstandard.ZstdCompressor(1).compress
        made = {"shard": [], "n": [], "grams": []}
        cuts = np.flatnonzero(np.diff(shard[first])) + 1
        for part in np.split(np.arange(len(first)), cuts):
            at = first[part]
            made["shard"].append(int(shard[at[0]]))
            made["n"].append(len(at))
            columns = (x.astype(layout.kind) for x in (np.diff(u[at], prepend=np.uint64(0)), v[at], w[at], times[part]))
            made["grams"].append(squeeze(b"".join(c.tobytes() for c in columns)))
        return made

    def write_shard(table: pa.Table) -> pa.Table:
        shard = int(table.column("shard")[0].as_py())
        loose = zstandard.ZstdDecompressor().decompress
        parts = [np.frombuffer(loose(x), layout.kind).reshape(4, -1) for x in table.column("grams").to_pylist()]
        u = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        v, w, times = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        arrays, facts, spread = shard_arrays(u, v.astype(np.uint64), w.astype(np.uint64), times, layout.kind)
        put(f"{path}/trie-{shard}", packed(arrays, **facts))
        return pa.table({"u": pa.array(spread[0], pa.int64()), "n": pa.array(spread[1], pa.int64()), "followers": pa.array(spread[2], pa.int64())})

    grams = map_texts(rows, "text", "shard int, n int, grams binary", collect, lambda: Vocabulary(layout))
    followers = grams.groupBy("shard").applyInArrow(write_shard, "u long, n long, followers long")
    # Only words with more than a shard's tokens: at most as many as there are shards.
    hot = followers.groupBy("u").agg(F.sum("n").alias("n"), F.sum("followers").alias("followers")).where(f"n >= {SHARD_TOKENS}").toArrow() if tokens else None
    arrays = {"u": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "followers": np.zeros(0, np.int64)}
    if hot is not None:
        order = np.argsort(hot.column("u").to_numpy())
        arrays = {k: hot.column(k).to_numpy()[order] for k in arrays}
    put(f"{path}/hot", packed(arrays))
    return layout


def _coded(name: str, values: np.ndarray, arrays: dict, facts: dict) -> None:
    own, facts[name] = EliasFano.arrays(values)
    arrays.update({f"{name}.{k}": x for k, x in own.items()})


def _relative(children: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Successors (ascending in each context) as one increasing sequence: each context's values go on
    from the last of the context before."""
    ends = np.concatenate([starts[1:], [len(children)]]) - 1
    shift = np.concatenate([[0], np.cumsum(children[ends].astype(np.uint64) + np.uint64(1))[:-1]]).astype(np.uint64)
    return children.astype(np.uint64) + np.uint64(1) + np.repeat(shift, np.diff(np.concatenate([starts, [len(children)]])))


def shard_arrays(u: np.ndarray, v: np.ndarray, w: np.ndarray, times: np.ndarray, kind: str) -> tuple[dict, dict, tuple]:
    """A shard's levels; and (u, tokens, followers) of its words that may go on in other shards."""
    order = np.lexsort((w, *_by_grams(u, v, kind)))
    u, v, w, times = u[order], v[order], w[order], times[order].astype(np.int64)
    other = lambda: (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(np.concatenate([[True], other() | (w[1:] != w[:-1])]))
    times, u, v, w = np.add.reduceat(times, at), u[at], v[at], w[at]
    second = np.flatnonzero(np.concatenate([[True], other()]))
    pair_times = np.add.reduceat(times, second)
    first_words, pairs = u[second], v[second]
    first = np.flatnonzero(np.concatenate([[True], first_words[1:] != first_words[:-1]]))
    word_times = np.add.reduceat(pair_times, first)
    word_followers = np.diff(np.concatenate([first, [len(pairs)]]))
    pair_followers = np.diff(np.concatenate([second, [len(w)]]))
    arrays: dict[str, np.ndarray] = {}
    facts: dict[str, int] = {}
    _coded("first", first_words[first], arrays, facts)
    _coded("to_second", np.concatenate([first, [len(pairs)]]), arrays, facts)
    _coded("second", _relative(pairs, first), arrays, facts)
    _coded("to_third", np.concatenate([second, [len(w)]]), arrays, facts)
    _coded("third", _relative(w, second), arrays, facts)
    per_pair = np.repeat(word_times, word_followers)
    arrays["times"] = word_times
    arrays["ratio2"] = quantised(pair_times / per_pair)
    arrays["ratio3"] = quantised(times / np.repeat(pair_times, pair_followers))
    arrays["left1"] = quantised(BACK * word_followers / (BACK * word_followers + word_times))
    arrays["left2"] = quantised(BACK * pair_followers / (BACK * pair_followers + pair_times))
    # A word that is in several shards has its tokens split; each says what it has.
    many = np.flatnonzero(word_times > 0)
    return arrays, facts, (first_words[first][many].astype(np.int64), word_times[many], word_followers[many])


class Trie:
    """The mapped shards, opened as they are needed."""

    def __init__(self, layout: Layout):
        self.layout, self.open = layout, {}
        hot = opened(f"{layout.path}/hot")[0]
        self.hot = {k: np.array(x) for k, x in hot.items()}

    def shard(self, i: int) -> tuple[dict, dict[str, EliasFano]]:
        if i not in self.open:
            try:
                arrays, facts = opened(f"{self.layout.path}/trie-{i}")
            except FileNotFoundError:  # no n-gram fell to it
                self.open[i] = ({}, {})
                return self.open[i]
            coded = {n: EliasFano({k: arrays[f"{n}.{k}"] for k in ("low", "high", "before")}, bits) for n, bits in facts.items()}
            self.open[i] = (arrays, coded)
        return self.open[i]

    def walk(self, u: np.ndarray, v: np.ndarray, count: np.ndarray, then: np.ndarray):
        """For contexts u: the ratio of v after u and l(u); for contexts u v: that of ``then`` and l(u v).

        Ratios are 0 and l is 1 where there is no such context or successor. ``then`` is below 0 where
        nothing follows.
        """
        n = len(u)
        ratio2, left1, ratio3, left2 = np.zeros(n), np.ones(n), np.zeros(n), np.ones(n)
        shard = self.layout.shard_of(u, v, count)
        # By shard and pair: neighbours in the files are looked up one after another.
        order = np.lexsort((*_by_grams(u, v, self.layout.kind), shard))
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if n else []:
            arrays, coded = self.shard(int(shard[own[0]]))
            if not arrays:
                continue
            new = np.concatenate([[True], np.diff(u[own]) != 0])  # a word's place is searched once
            words = u[own[new]]
            root = coded["first"].find(words, np.zeros(len(words), np.int64), np.full(len(words), coded["first"].n))[np.cumsum(new) - 1]
            own, root = own[root >= 0], root[root >= 0]
            left1[own] = restored(arrays["left1"][root])
            if not len(own):
                continue
            new = np.concatenate([[True], (np.diff(u[own]) != 0) | (np.diff(v[own]) != 0)])  # and so is a pair's
            node = self._child(coded["to_second"], coded["second"], root[new], v[own[new]])[np.cumsum(new) - 1]
            hit = node >= 0
            own, node, root = own[hit], node[hit], root[hit]
            # Ratios are to the shard's own tokens of u; those of a word in many shards are put right.
            ratio2[own] = restored(arrays["ratio2"][node]) * (arrays["times"][root] / np.maximum(count[own], 1))
            on = then[own] >= 0
            own, node = own[on], node[on]
            left2[own] = restored(arrays["left2"][node])
            leaf = self._child(coded["to_third"], coded["third"], node, then[own])
            hit = leaf >= 0
            ratio3[own[hit]] = restored(arrays["ratio3"][leaf[hit]])
        if len(self.hot["u"]):
            at = np.minimum(np.searchsorted(self.hot["u"], u.astype(np.int64)), len(self.hot["u"]) - 1)
            hit = self.hot["u"][at] == u.astype(np.int64)
            followers = BACK * self.hot["followers"][at]
            left1[hit] = (followers / (followers + self.hot["n"][at]))[hit]
        return ratio2, left1, ratio3, left2

    @staticmethod
    def _child(pointers: EliasFano, children: EliasFano, parent: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The successor's place in the parent's range: searched as the last value before it, plus the value."""
        low, high = (x.astype(np.int64) for x in pointers.access_two(parent))
        before = np.zeros(len(low), np.uint64)
        inner = np.flatnonzero(low > 0)
        before[inner] = children.access(low[inner] - 1)
        return children.find(before + value.astype(np.uint64) + np.uint64(1), low, high)


def score(df: DataFrame, layout: Layout, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` of ``df``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""

    def work(batch: pa.RecordBatch, model: tuple[Vocabulary, Trie]) -> dict:
        vocabulary, trie = model
        ids, counts, lengths = vocabulary.tokens(texts_of(batch, "text"))
        starts = np.cumsum(lengths) - lengths
        base = (counts + ADD) / (layout.tokens + ADD * (layout.words + 1))
        one, one_count, _, _ = _contexts(ids, counts, lengths, layout)
        unseen = layout.outside - 1  # no word has this id
        words = np.where(ids >= 0, ids, unseen)
        # The context of a word is (two, one); the pair (one, word) is looked up where the word stands and
        # is the context of the word after it.
        after = np.append(words[1:], -1)
        after[starts[1:] - 1] = -1
        p = base.copy()
        seen = np.flatnonzero(one >= 0)
        ratio, left, next_ratio, next_left = trie.walk(one[seen], words[seen], one_count[seen], after[seen])
        p[seen] = (1 - left) * ratio + left * base[seen]
        following = seen[after[seen] >= 0] + 1
        inner = after[seen] >= 0
        p[following] = (1 - next_left[inner]) * next_ratio[inner] + next_left[inner] * p[following]
        return {
            "n_tokens": lengths,
            "n_known": np.add.reduceat((counts > 0).astype(np.int64), starts),
            "train_tokens": np.full(len(lengths), layout.tokens),
            "base_score": np.add.reduceat(np.log10(base), starts),
            "score": np.add.reduceat(np.log10(p), starts),
        }

    fields = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return beside(df, columns, text_column, fields, work, lambda: (Vocabulary(layout), Trie(layout)))
