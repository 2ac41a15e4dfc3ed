"""Removal of repeated passages by suffix arrays.

Every byte of a text that is covered by a string of ``LENGTH`` bytes which also starts anywhere else
(in another text, or elsewhere in the same) is removed. The strings are judged on the input.

1. *Dealing.* Each window of ``LENGTH`` bytes belongs to the smallest hash of the ``GRAM``-byte
   strings in it, so equal windows belong together wherever they stand. Neighbouring windows of one
   hash are a segment. Counts by (hash, content of the segment) are combined before the shuffle, and
   hashes that occur once end here: nothing in their windows can repeat.
2. *Shards.* Each distinct segment goes once, with the number of its copies, to the shard of its hash.
   A shard sorts its suffixes by refinement over twice the length each time, up to ``LENGTH``: windows
   that are one group then are equal, and repeated if the group holds two, copies counted.
3. *Across shards.* The segments of a hash with very many are spread over several shards. Each pair of
   these shards is merged by binary search of the one's windows among the other's sorted windows.
4. *Cutting.* The repeated windows of a segment are those of all its copies; they are put together for
   each text and cut out.

The same goes for runs of words (``strip`` and ``dedup`` with ``words``): every run of so many words, as
white space parts them, that also starts elsewhere is removed too, whatever its bytes. A word is a
64-bit hash then, and takes the place of a byte in all the steps.

Every occurrence goes, the first included: a passage that stands in two documents is in neither afterwards.
Null texts count as empty; texts shorter than ``LENGTH`` are left alone; copies of texts, repeated
rows and ties are all cut alike (every occurrence goes). Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from portcullis.llm.common import Scratch, apart, beside, hand_back, map_texts, new_column, written

LENGTH, GRAM = 400, 64
#: The same in words: the strings that windows are dealt by are shorter, for few words at least.
WORD_GRAM = 16
#: Text of a shard, about, and of one hash in a shard at most.
SHARD_BYTES, HASH_BYTES = 2 << 20, 256 << 10
#: Bytes of text whose windows are hashed together: each byte takes several numbers for a while.
PORTION = 1 << 20
#: Window starts looked at together in one text.
REACH = 1 << 22
#: Bytes of short texts that are cut into segments together, and places that are sorted at a time.
TOGETHER, SORTED = 1 << 16, 1 << 15
#: Bytes of a word that are hashed beside those of other words.
WORD_BYTES = 64


@dataclass(frozen=True)
class Unit:
    """What texts are strings of: how many make a window, how many one of the strings it is dealt by."""

    length: int
    gram: int
    kind: str

    @property
    def span(self) -> int:
        """Dealing strings in a window, and windows in a segment at most."""
        return self.length - self.gram + 1

    @property
    def size(self) -> int:
        return np.dtype(self.kind).itemsize

    @property
    def least_bytes(self) -> int:
        """No shorter text has a window: words are a byte and a blank at least."""
        return self.length if self.size == 1 else 2 * self.length - 1

    def read(self, data: bytes) -> np.ndarray:
        if self.size == 1:
            return np.frombuffer(data, np.uint8)
        return word_hashes(data)


BYTES = Unit(LENGTH, GRAM, "u1")


def word_unit(words: int) -> Unit:
    gram = 1
    while gram < WORD_GRAM and gram * 4 <= words:
        gram *= 2
    return Unit(words, gram, "<u8")


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; words are those of ``bytes.split``."""
    value = np.frombuffer(data, np.uint8)
    letter = np.concatenate([[False], (value != 32) & ((value < 9) | (value > 13)), [False]])
    return np.flatnonzero(letter[1:] & ~letter[:-1]), np.flatnonzero(letter[:-1] & ~letter[1:])


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return value ^ (value >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words, from their lengths and 8 bytes at a time; XXH64 of long ones."""
    begin, end = word_bounds(data)
    size = end - begin
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    held = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    value = _mixed(size.astype(np.uint64))
    for at in range(0, WORD_BYTES, 8):
        own = np.flatnonzero(size > at)
        if not len(own):
            break
        value[own] = _mixed(value[own] ^ (eight[begin[own] + at] & held[np.minimum(size[own] - at, 8)]))
    for i in np.flatnonzero(size > WORD_BYTES).tolist():
        value[i] = xxhash.xxh64_intdigest(data[begin[i] : end[i]])
    return value


def _gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` units from each position on, by doubling."""
    value, size, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < gram:
        value = value[:-size] * np.uint64(factor) + value[size:]
        factor, size = factor * factor % (1 << 64), size * 2
    value ^= value >> np.uint64(33)
    value *= np.uint64(0xFF51AFD7ED558CCD)
    value ^= value >> np.uint64(29)
    return value


def segments(data: np.ndarray, unit: Unit = BYTES, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment of a text: hash, first window, number of windows, whether the hash is in it twice.

    With ``ends``, ``data`` is several texts one after another, and no window crosses their ends.
    """
    found, span = [], unit.span
    for base in range(0, max(0, len(data) - unit.length + 1), REACH):
        part = data[base : base + REACH + unit.length - 1]
        grams = _gram_hashes(part, unit.gram)
        # 40 bits of the hash and the place, so that the leftmost of equal hashes is the smallest
        least = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        at = np.arange(base, base + len(place))
        if ends is not None and len(ends) > 1:
            inside = at + unit.length <= np.repeat(ends, np.diff(ends, prepend=0))[at]
            at, place = at[inside], place[inside]
            if not len(at):
                continue
        value = grams[place]
        moved = np.concatenate([[False], place[1:] != place[:-1]])
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)])
        starts = np.flatnonzero(new)
        run = np.diff(np.concatenate([starts, [len(value)]]))
        if (run > span).any():  # cut long runs
            pieces = -(-run // span)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = np.repeat(starts, pieces) + nth * span
            ends = np.minimum(starts + span, np.repeat(np.concatenate([np.flatnonzero(new)[1:], [len(value)]]), pieces))
            run = ends - starts
        inner = moved & ~new
        twice = np.add.reduceat(inner.astype(np.int64), starts) > 0
        found.append((value[starts], at[starts], run, twice))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate([x[i] for x in found]) for i in range(4))


def segments_of_each(texts: list[bytes], unit: Unit = BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Of some texts at a time, of each segment: number of the text, the columns of ``segments``, digest of the content.

    Most texts are short, so several of them are looked at as one.
    """
    first, some, size = 0, [], 0
    for n, text in enumerate(texts):
        some.append(text)
        size += len(text)
        if size < TOGETHER and n + 1 < len(texts):
            continue
        if unit.size == 1:
            data, ends = unit.read(b"".join(some)), np.cumsum([len(x) for x in some])
        else:
            data = unit.read(b" ".join(some))
            ends = np.cumsum([len(word_bounds(x)[0]) for x in some])
        value, start, windows, twice = segments(data, unit, ends)
        which = np.searchsorted(ends, start, "right")
        view, last = memoryview(data), start + windows + unit.length - 1
        contents = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), last.tolist(), strict=True)]
        yield first + which, value, start - np.concatenate([[0], ends])[which], windows, twice, contents
        first, some, size = n + 1, [], 0


def _order(group: np.ndarray, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """What sorts by ascending group and then by value (0 to ``most``), and which of the sorted begin another pair.

    Numbers with their places in the low bits are sorted as they are, which is several times as fast as sorting places.
    """
    place, width = len(value).bit_length(), int(most).bit_length()
    high = group - group[0]
    if int(high[-1]).bit_length() + width + place > 64:
        by = np.lexsort((value, group))
        high, value = high[by], value[by]
        return by, np.concatenate([[True], (high[1:] != high[:-1]) | (value[1:] != value[:-1])])
    key = high.astype(np.uint64)
    key <<= np.uint64(width)
    key |= value.astype(np.uint64)
    key <<= np.uint64(place)
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    by = (key & np.uint64((1 << place) - 1)).view(np.int64)
    key >>= np.uint64(place)
    return by, np.concatenate([[True], key[1:] != key[:-1]])


def suffix_array(text: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes and each one's rank: ordered by a few bytes (one word) first, then groups of equals are
    refined by the rank of what follows, over twice the length each time.

    With ``depth``, suffixes are told apart by so many units only: those that agree in them have one rank, that of
    the first in the order.
    """
    n = len(text)
    kind = np.int32 if n < 1 << 30 else np.int64
    if text.itemsize == 1:
        place = n.bit_length()
        step = (64 - place) // 8
        padded = np.concatenate([text, np.zeros(step, text.dtype)])
        first = np.zeros(n, np.uint64)
        for i in range(step):
            first = (first << np.uint64(8)) | padded[i : n + i]
        first = np.sort((first << np.uint64(place)) | np.arange(n, dtype=np.uint64))
        order = (first & np.uint64((1 << place) - 1)).astype(kind)
        first >>= np.uint64(place)
    else:
        step, order = 1, np.argsort(text).astype(kind)
        first = text[order]
    starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])).astype(kind)
    sizes = np.diff(starts, append=kind(n))
    # Zero bytes and the end look alike in these; past the end ranks below all else, the later the lower.
    rank = np.arange(n - 1, -9 - min(n, depth or n), -1, dtype=kind)
    rank[order] = np.repeat(starts, sizes)
    slots, group, ends = _of_equals(np.arange(n, dtype=kind), sizes)
    while len(slots) and (depth is None or step < depth):
        ahead = step if depth is None else min(step, depth - step)
        new = np.empty(len(slots), bool)
        # Groups stand one after another, so some of them at a time can be sorted.
        ends = np.unique(ends[np.searchsorted(ends, np.arange(0, len(slots) + SORTED, SORTED)).clip(max=len(ends) - 1)])
        for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own = slots[low:high]
            members = order[own]
            by, new[low:high] = _order(group[low:high], rank[members + kind(ahead)] + kind(ahead), n + ahead)
            order[own] = members[by]
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(slots))
        # All at once, as the ranks of this round's length are those of what follows.
        rank[order[slots]] = np.repeat(slots[starts], sizes)
        slots, group, ends = _of_equals(slots, sizes)
        step += ahead
    return order, rank[:n]


def _of_equals(slots: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups of slots, one after another, those with more members than one: slots, the number of each one's
    group, and where groups begin and end."""
    more = sizes > 1
    held = sizes[more]
    return slots[np.repeat(more, sizes)], np.repeat(np.arange(len(held), dtype=slots.dtype), held), np.concatenate([[0], np.cumsum(held)])


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, lanes: int = 4096) -> np.ndarray:
    """Of each suffix in order, the common prefix with the one before it, after Kasai (the order of whole suffixes,
    without a depth; shards need none).

    The text is cut into lanes that go forward side by side, each at its own pace: 8 more bytes (one
    more word), or one position on, where the common prefix is shorter by one at most.
    """
    n = len(text)
    at_once, bits = 8 // text.itemsize, (8 * text.itemsize).bit_length() - 1
    padded = np.concatenate([text, np.zeros(at_once, text.dtype)])
    words = np.zeros(n + 1, np.uint64)
    for i in range(at_once):
        words[:n] |= padded[i : n + i].astype(np.uint64) << np.uint64(8 * i)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    result = np.zeros(n, np.int64)
    at = np.arange(0, n, -(-n // lanes))
    end = np.concatenate([at[1:], [n]])
    same = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        i, j = at + same, np.maximum(other, 0) + same
        differ = words[i] ^ words[j]
        more = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> bits
        left = np.where(other < 0, 0, n - np.maximum(i, j))
        same += np.minimum(more, left)
        done = (more < at_once) | (left <= at_once)
        result[rank[at[done]]] = same[done]
        same -= done & (same > 0)
        at += done
        if (at == end).any():
            on = at < end
            at, end, same = at[on], end[on], same[on]
    return result


class Shard:
    """Segments one after another, their sorted suffixes and the runs of equal windows."""

    def __init__(self, contents: list[bytes], windows: np.ndarray, copies: np.ndarray, unit: Unit = BYTES):
        self.text, self.length = np.frombuffer(b"".join(contents), unit.kind), unit.length
        lengths = windows + unit.length - 1
        self.begin = np.cumsum(lengths) - lengths
        self.windows = windows
        self.rank = suffix_array(self.text, unit.length)[1]
        # Segments end where others begin, so only positions where a window starts count.
        total = int(windows.sum())
        self.segment = np.repeat(np.arange(len(windows)), windows)
        self.at = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + self.begin[self.segment]
        self.run = self.rank[self.at]
        self.copies = copies[self.segment]
        held = np.bincount(self.run, self.copies, len(self.text) + 1)
        self.repeated = held[self.run] >= 2

    def found(self, other: Shard) -> None:
        """Mark the windows that ``other`` has too, by binary search among its sorted windows."""
        by = np.argsort(other.rank[other.at], kind="stable")
        sorted_at, sorted_run = other.at[by], other.run[by]
        first = np.concatenate([[True], sorted_run[1:] != sorted_run[:-1]])
        among = sorted_at[first]
        own, back = np.unique(self.run, return_index=True)
        wanted = self.at[back]
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(among))
        equal = np.zeros(len(wanted), bool)
        while (open_ := np.flatnonzero((low < high) & ~equal)).size:
            middle = (low[open_] + high[open_]) // 2
            sign = _compare(self.text, wanted[open_], other.text, among[middle], self.length)
            equal[open_[sign == 0]] = True
            high[open_[sign < 0]] = middle[sign < 0]
            low[open_[sign > 0]] = middle[sign > 0] + 1
        self.repeated |= np.isin(self.run, own[equal])

    def spans(self) -> Iterator[tuple[int, int, int]]:
        """(segment, first, last) of the runs of repeated windows."""
        place = self.at - self.begin[self.segment]
        hit = np.flatnonzero(self.repeated)
        if not len(hit):
            return
        breaks = np.flatnonzero((np.diff(hit) > 1) | (np.diff(self.segment[hit]) != 0)) + 1
        for part in np.split(hit, breaks):
            yield int(self.segment[part[0]]), int(place[part[0]]), int(place[part[-1]])


def _compare(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, length: int) -> np.ndarray:
    """Signs of windows of ``a`` against windows of ``b``."""
    sign = np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    for k in range(0, length, 16):
        x = a[at[todo, None] + np.arange(k, min(k + 16, length))]
        y = b[bt[todo, None] + np.arange(k, min(k + 16, length))]
        column = (x != y).argmax(1)
        x, y = (side[np.arange(len(todo)), column] for side in (x, y))
        value = (x > y).astype(np.int64) - (x < y)
        sign[todo] = value
        todo = todo[value == 0]
        if not len(todo):
            break
    return sign


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


SEGMENT = "hash long, content binary"
FOUND = f"{SEGMENT}, first int, last int"


def repeats(df: DataFrame, text_column: str, unit: Unit, scratch: Scratch) -> DataFrame:
    """(key, spans): of each text with repeated windows, its ``text_key`` and its (first, last) windows.

    What is written on the way goes with ``scratch``, once the result is written itself.
    """
    spark, written, early = df.sparkSession, scratch.written, Scratch(df.sparkSession)
    texts = df.where(F.octet_length(text_column) >= unit.least_bytes).select(text_key(F.col(text_column)).alias("key"), F.col(text_column).alias("text"))

    def cut(batch: pa.RecordBatch) -> dict:
        found = [*segments_of_each([t.encode() for t in batch.column("text").to_pylist()], unit)]
        which, value, start, windows, twice = (np.concatenate([x[i] for x in found]) for i in range(5))
        keys = batch.column("key").take(pa.array(which))
        return {"key": keys, "hash": value.view(np.int64), "content": [c for x in found for c in x[5]], "start": start, "windows": windows, "twice": twice}

    dealt = written(map_texts(texts, "text", "key binary, hash long, content binary, start int, windows int, twice boolean", cut, most=PORTION), "segments")
    distinct = early.written(
        dealt.groupBy("hash", "content").agg(F.count("*").alias("copies"), F.max("twice").alias("twice"), F.min(F.struct("key", "start", "windows")).alias("at")),
        "contents",
    )
    per_hash = (
        distinct.groupBy("hash")
        .agg(F.sum("copies").alias("copies_of_hash"), F.max("twice").alias("twice"), F.sum((F.col("at.windows") + unit.length - 1) * unit.size).alias("bytes"))
        .where("copies_of_hash > 1 or twice")
    )
    hashes = early.written(per_hash.select("hash", "bytes", F.ceil(F.col("bytes") / HASH_BYTES).cast("int").alias("parts")), "hashes")
    total = hashes.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    part = F.pmod(F.xxhash64("content"), F.col("parts")).cast("int")
    wanted = (
        distinct.join(hashes.select("hash", "parts"), "hash")
        .select("at.key", F.struct("hash", "content", F.least("copies", F.lit(2)).cast("int").alias("copies"), "parts", part.alias("part"), "at.start", "at.windows").alias("one"))
        .groupBy("key")
        .agg(F.collect_list("one").alias("all"))
    )
    once = texts.groupBy("key").agg(F.first("text").alias("text"))

    def read(batch: pa.RecordBatch) -> dict:
        rows = []
        for text, every in zip(batch.column("text").to_pylist(), batch.column("all").to_pylist(), strict=True):
            data = unit.read(text.encode())
            rows += [x | {"bytes": data[x["start"] : x["start"] + x["windows"] + unit.length - 1].tobytes()} for x in every]
        return {k: [r[k] for r in rows] for k in ("hash", "content", "copies", "parts", "part", "windows", "bytes")}

    placed = written(map_texts(once.join(wanted, "key"), "text", f"{SEGMENT}, copies int, parts int, part int, windows int, bytes binary", read, most=PORTION), "placed")

    early.clear()
    nothing = to_arrow_schema(StructType.fromDDL(FOUND)).empty_table()

    def shard_of(table: pa.Table) -> Shard:
        return Shard(table.column("bytes").to_pylist(), table.column("windows").to_numpy().astype(np.int64), table.column("copies").to_numpy(), unit)

    def rows_of(table: pa.Table, shard: Shard) -> pa.Table:
        spans = [*shard.spans()]
        which = pa.array([s for s, _, _ in spans], pa.int64())
        return pa.table(
            {
                "hash": table.column("hash").take(which),
                "content": table.column("content").take(which),
                "first": pa.array([f for _, f, _ in spans], pa.int32()),
                "last": pa.array([x for _, _, x in spans], pa.int32()),
            }
        )

    def sort(table: pa.Table) -> pa.Table:
        made = rows_of(table, shard_of(table))
        hand_back()
        return made

    def merge(table: pa.Table) -> pa.Table:
        side = table.column("part").to_numpy()
        low = side.min()
        halves = [table.filter(pa.array(side == low)), table.filter(pa.array(side != low))]
        if not halves[1].num_rows:
            return nothing
        pair = [shard_of(h) for h in halves]
        for shard in pair:
            shard.repeated[:] = False
        pair[0].found(pair[1])
        pair[1].found(pair[0])
        made = pa.concat_tables([rows_of(h, s) for h, s in zip(halves, pair, strict=True)])
        del pair, shard
        hand_back()
        return made

    sharded = placed.withColumn("shard", F.pmod(F.xxhash64("hash", "part"), F.lit(shards)))
    inside = sharded.groupBy("shard").applyInArrow(sort, FOUND)
    others = F.expr("filter(sequence(0, parts - 1), p -> p <> part)")
    across = (
        placed.where("parts > 1")
        .withColumn("other", F.explode(others))
        .withColumn("low", F.least("part", "other"))
        .withColumn("high", F.greatest("part", "other"))
        .groupBy("hash", "low", "high")
        .applyInArrow(merge, FOUND)
    )
    found = written(inside.unionByName(across), "repeated")
    return (
        dealt.join(found, ["hash", "content"])
        .groupBy("key")
        .agg(F.collect_set(F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))).alias("spans"))
    )


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left without the bytes of the spans (begin, end), and the number of maximal removed runs."""
    kept, at, runs = [], 0, 0
    reach = -1
    for begin, end in sorted(spans):
        if begin > reach:  # touching runs are one
            kept.append(data[max(at, 0) : begin])
            runs += 1
        reach = max(reach, end)
        at = reach
    kept.append(data[at:])
    return b"".join(kept), runs


def strip(df: DataFrame, columns: list[str], text_column: str = "text", words: int | None = None, cut_words: bool = True) -> DataFrame:
    """``columns`` of ``df``, with ``n_bytes``, ``n_removed``, ``n_spans``, and what is ``kept`` as bytes.

    With ``words``, repeated runs of so many words are found as well: ``n_passage_bytes`` says how many
    bytes stand in such runs, and they go beside the strings of ``LENGTH`` bytes if ``cut_words``. Result
    columns whose names are in ``columns`` get underscores.
    """
    text = F.col(f"`{text_column}`")
    joined = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.coalesce(text, F.lit("")).alias("text"), text_key(text).alias("key"))
    units = {"spans": BYTES} | ({"word_spans": word_unit(words)} if words else {})
    for name, unit in units.items():
        scratch = Scratch(df.sparkSession)
        found = written(repeats(df.select(text.alias("text")), "text", unit, scratch).withColumnRenamed("spans", name), "spans")
        scratch.clear()
        joined = joined.join(found, "key", "left")

    def work(batch: pa.RecordBatch) -> dict:
        made = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []} | ({"n_passage_bytes": []} if words else {})
        of_words = batch.column("word_spans").to_pylist() if words else [None] * batch.num_rows
        for text, spans, word_spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), of_words, strict=True):
            data = text.encode()
            gone = [(s["first"], s["last"] + LENGTH) for s in spans or ()]
            passages = []
            if word_spans:
                begin, end = word_bounds(data)
                passages = [(int(begin[s["first"]]), int(end[s["last"] + words - 1])) for s in word_spans]
            left, n = kept_bytes(data, gone + passages if cut_words else gone)
            made["n_bytes"].append(len(data))
            made["n_removed"].append(len(data) - len(left))
            made["n_spans"].append(n)
            made["kept"].append(left)
            if words:
                made["n_passage_bytes"].append(len(data) - len(kept_bytes(data, passages)[0]))
        return made

    own = [f"c{i}" for i in range(len(columns))]
    fields = "n_bytes long, n_removed long, n_spans long, kept binary" + (", n_passage_bytes long" if words else "")
    made = beside(joined, own, "text", fields, work, most=PORTION, more={name: F.col(name) for name in units})
    return made.toDF(*columns, *apart(columns, made.columns[len(own) :]))


def dedup(df: DataFrame, text_column: str = "text", words: int | None = None) -> DataFrame:
    """``df`` with the repeated passages cut out of its texts, those of so many ``words`` too.

    A cut may fall inside a character; the bytes of such a character that are left go too. Null
    texts stay null.
    """
    null = new_column(df, "null")
    others = [c for c in df.columns if c != text_column]
    cut = strip(df.withColumn(null, F.col(f"`{text_column}`").isNull()), [*others, null], text_column, words)
    kept = F.col(f"`{cut.columns[len(others) + 4]}`").cast("string")
    whole = F.call_function("try_validate_utf8", kept)
    mended = F.regexp_replace(F.call_function("make_valid_utf8", kept), "\ufffd", "")
    text = F.when(~F.col(f"`{null}`"), F.coalesce(whole, mended))
    return cut.select(*[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in df.columns])
