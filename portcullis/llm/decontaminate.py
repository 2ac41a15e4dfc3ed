"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of the test items.

Every training text is cut into overlapping passages, each twice as long as the longest item and half
a length on, so an item stands whole in one of them. A passage is a query: the items' BM25 scores
(each a share of what is needed, see below) are retrieved if they reach 1. Retrieved items are then
verified: at least ``SIMILARITY`` of the item's shingles of five words must be in the text, and
``PART`` of those of its question and of its answer.

An item may also stand in a text in parts, with other text between them that no passage spans. So every
text is looked up as a whole too: items that have ``SIMILARITY`` of their shingles in it, by the shingles'
hashes, are verified as well, with the score of the whole text.

An item that verifies in a passage lacks no more words than it may lack shingles, so a passage that holds it has
at least the item's own score without its heaviest so many words: that is what is needed, and no
item is lost before it is verified. Words are runs of letters, digits and underscores in lower case.

The index is small beside the corpus but grows with the benchmark, so it is built in parts of about
``PART_BYTES`` of item text, and each part goes over the texts in a pass of its own. Document
frequencies are those of the whole benchmark.

Without an answer column, an item's last ``ANSWER`` of its words are the answer. Null and empty items
and texts match nothing; items of fewer words than a shingle are one shingle; repeated items and rows
are matched each. Other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from portcullis.llm.common import beside, map_texts, new_column, texts_of, written

K1, B = 1.2, 0.75
SHINGLE, SIMILARITY, PART, ANSWER = 5, 0.8, 0.5, 0.2
PART_BYTES = 8 << 20
#: Bytes of text whose passages are tested together: each word there takes a row of sums for a while.
PORTION = 1 << 20
#: Entries in a block of a posting list, items in a block of the test over all passages at once.
BLOCK, ITEMS = 16, 4
#: A word that stands in one of so many blocks of items or more has a row of them all; sums (chunks by blocks) held at once.
DENSE, SUMS = 16, 4 << 20
words_of = re.compile(r"\w+").findall


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


class Index:
    """Posting lists of a part of the items, with the largest impact of each block."""

    def __init__(self, items: list[dict], frequency: dict[str, int], total: int, mean: float):
        items = sorted(items, key=lambda x: len(x["words"]))  # so that a block's impacts are much alike
        self.ids = [x["id"] for x in items]
        self.shingles = [shingles(x["words"]) for x in items]
        self.questions = [len(shingles(x["words"])) - x["answer_shingles"] for x in items]
        self.reach = max((len(x["words"]) for x in items), default=1)
        self.postings: dict[str, tuple[list[int], list[float], list[float]]] = {}
        lists: dict[str, list[tuple[int, float]]] = {}
        for i, item in enumerate(items):
            counts = Counter(item["words"])
            weight = {
                w: float(np.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5))) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(item["words"]) / mean))
                for w, n in counts.items()
            }
            lacking = int((1 - SIMILARITY) * len(self.shingles[i]) + 1e-9)
            needed = sum(sorted(weight.values())[: max(1, len(weight) - lacking)]) - 1e-9
            for w, value in weight.items():
                lists.setdefault(w, []).append((i, value / needed))
        for w, found in lists.items():
            found.sort()
            values = [v for _, v in found]
            self.postings[w] = ([i for i, _ in found], values, [max(values[k : k + BLOCK]) for k in range(0, len(values), BLOCK)])
        self.most = {w: max(p[2]) for w, p in self.postings.items()}
        # The shingles of all items by hash; shorter ones always stand whole in a passage.
        every = [(i, s) for i, own in enumerate(self.shingles) for s in own if len(s) == SHINGLE]
        term = {w: i for i, w in enumerate(self.postings)}
        codes = _codes(np.fromiter((term[w] for _, s in every for w in s), np.int64, SHINGLE * len(every)))[::SHINGLE]
        order = np.argsort(codes, kind="stable")
        self.codes, begin = np.unique(codes[order], return_index=True)
        self.code_ends = np.append(begin, len(codes))
        self.code_items = np.fromiter((i for i, _ in every), np.int64, len(every))[order]
        # For each word its largest impact on each block of items: a row of all blocks for words that stand in many
        # of them (so these rows are at most ``DENSE`` times as large as the postings), a list for the others.
        self.term = {w: i for i, w in enumerate(self.postings)}
        self.width = -(-len(items) // ITEMS)
        self.row = np.full(len(self.term), -1)
        lists_of: list[tuple[np.ndarray, np.ndarray]] = []
        rows = []
        for i, (at, values, _) in enumerate(self.postings.values()):
            block, begin = np.unique(np.array(at) // ITEMS, return_index=True)
            most = np.maximum.reduceat(np.array(values, np.float32), begin)
            if len(block) * DENSE >= self.width:
                self.row[i] = len(rows)
                rows.append(np.zeros(self.width, np.float32))
                rows[-1][block] = most
                block, most = block[:0], most[:0]
            lists_of.append((block, most))
        self.rows = np.array(rows, np.float32).reshape(len(rows), self.width)
        self.list_ends = np.concatenate([[0], np.cumsum([len(b) for b, _ in lists_of])]).astype(np.int64)
        self.list_blocks = np.concatenate([np.zeros(0, np.int64), *[b for b, _ in lists_of]])
        self.list_values = np.concatenate([np.zeros(0, np.float32), *[m for _, m in lists_of]])

    def retrieve(self, words: set[str]) -> list[tuple[int, float]]:
        """Items of score 1 or more for a query, by block-max WAND."""
        cursors = [[self.postings[w], 0, self.most[w]] for w in words if w in self.postings]
        found = []
        end = len(self.ids)

        def at(c) -> int:
            return c[0][0][c[1]] if c[1] < len(c[0][0]) else end

        while True:
            cursors = [c for c in cursors if c[1] < len(c[0][0])]
            cursors.sort(key=at)
            bound, pivot = 0.0, -1
            for n, c in enumerate(cursors):
                bound += c[2]
                if bound >= 1:
                    pivot = n
                    break
            if pivot < 0:
                return found
            item = at(cursors[pivot])
            while pivot + 1 < len(cursors) and at(cursors[pivot + 1]) == item:
                pivot += 1
            in_blocks, beyond = 0.0, at(cursors[pivot + 1]) if pivot + 1 < len(cursors) else end
            for c in cursors[: pivot + 1]:
                k = bisect_left(c[0][0], item, c[1])
                block = k // BLOCK
                if block < len(c[0][2]):
                    in_blocks += c[0][2][block]
                    last = min((block + 1) * BLOCK, len(c[0][0])) - 1
                    beyond = min(beyond, max(item, c[0][0][last]) + 1)
            if in_blocks < 1:  # nothing before the nearest block's end can reach it
                for c in cursors[: pivot + 1]:
                    c[1] = bisect_left(c[0][0], max(beyond, item + 1), c[1])
            elif at(cursors[0]) == item:
                score = sum(c[0][1][c[1]] for c in cursors[: pivot + 1])
                if score >= 1:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    c[1] += 1
            else:
                for c in cursors[:pivot]:
                    c[1] = bisect_left(c[0][0], item, c[1])

    def whole(self, texts: list[list[str]]) -> list[list[int]]:
        """Of each text the items that have enough of their shingles anywhere in it."""
        found: list[list[int]] = [[] for _ in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        none = len(self.term)
        ids = np.fromiter(map(self.term.get, chain.from_iterable(texts), repeat(none)), np.int64, lengths.sum())
        if len(ids) < SHINGLE or not len(self.codes):
            return found
        owner = np.repeat(np.arange(len(texts)), lengths)
        before = np.concatenate([[0], np.cumsum(ids == none)])
        at = np.flatnonzero((before[SHINGLE:] == before[:-SHINGLE]) & (owner[SHINGLE - 1 :] == owner[: len(ids) - SHINGLE + 1]))
        value = _codes(ids)[at]
        place = np.minimum(np.searchsorted(self.codes, value), len(self.codes) - 1)
        hit = self.codes[place] == value
        pairs = np.unique(owner[at[hit]] * len(self.codes) + place[hit])
        text, place = pairs // len(self.codes), pairs % len(self.codes)
        for own in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(text)) + 1) if len(pairs) else ():
            items = np.concatenate([self.code_items[self.code_ends[p] : self.code_ends[p + 1]] for p in place[own].tolist()])
            item, hits = np.unique(items, return_counts=True)
            found[int(text[own[0]])] = [i for i, n in zip(item.tolist(), hits.tolist(), strict=True) if n >= SIMILARITY * len(self.shingles[i]) - 1e-9]
        return found

    def score(self, item: int, words: set[str]) -> float:
        """The score of an item for a query."""
        own = set(chain.from_iterable(self.shingles[item])) & words
        return sum(self.postings[w][1][bisect_left(self.postings[w][0], item)] for w in own)

    def promising(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Of each text the places where passages begin that can reach 1 in some block of items.

        This is the test for a pivot, over all passages at once: a passage is two chunks, and the
        block's largest impacts of their different words are summed.
        """
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        size, none = self.reach, len(self.term)
        ids = np.fromiter(map(self.term.get, chain.from_iterable(texts), repeat(none)), np.int64, lengths.sum())
        chunks = np.maximum(1, -(-lengths // size))
        first = np.cumsum(chunks) - chunks
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        chunk = np.repeat(first, lengths) + place // size
        known = ids < none
        pairs = np.unique(chunk[known] * none + ids[known])
        number = int(chunks.sum())
        able = np.zeros(number, bool)
        last = np.zeros(number, bool)
        last[first + chunks - 1] = True
        some = max(2, SUMS // max(1, self.width))
        owner = pairs // none if none else pairs
        for begin in range(0, number, some):  # chunks whose sums are held together, and the one after them
            end = min(begin + some, number)
            own = slice(*np.searchsorted(owner, [begin, end + 1]))
            sums = self._sums(owner[own] - begin, pairs[own] % max(1, none), end + 1 - begin)
            both = sums[:-1]
            inner = ~last[begin:end]
            both[inner] += sums[1:][inner]
            able[begin:end] = (both >= 1 - 1e-4).any(1)
        return [np.flatnonzero(able[f : f + n]) * size for f, n in zip(first.tolist(), chunks.tolist(), strict=True)]

    def _sums(self, owner: np.ndarray, term: np.ndarray, number: int) -> np.ndarray:
        """For each of ``number`` owners (ascending) the summed impacts of its words on each block of items."""
        sums = np.zeros((number, self.width), np.float32)
        often = np.flatnonzero(self.row[term] >= 0)
        if len(often):
            own = owner[often]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums[own[starts]] = np.add.reduceat(self.rows[self.row[term[often]]], starts)
        sizes = np.diff(self.list_ends)[term]
        if sizes.any():
            at = np.arange(sizes.sum()) + np.repeat(self.list_ends[term] - (np.cumsum(sizes) - sizes), sizes)
            cell = np.repeat(owner, sizes) * self.width + self.list_blocks[at]
            sums += np.bincount(cell, self.list_values[at], number * self.width).astype(np.float32).reshape(sums.shape)
        return sums

    def matches(self, words: list[str], begins: np.ndarray, whole: list[int]) -> list[tuple[int, float, float, float, float]]:
        """(item, score, overlap, overlap of question, of answer) of the items that a text holds."""
        best: dict[int, float] = {}
        for begin in begins.tolist():
            for item, score in self.retrieve(set(words[begin : begin + 2 * self.reach])):
                best[item] = max(score, best.get(item, 0.0))
        for item in whole:
            if item not in best:
                best[item] = self.score(item, set(words))
        if not best:
            return []
        own = set(shingles(words)) | set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        found = []
        for item, score in best.items():
            hits = [s in own if len(s) == SHINGLE else _has(words, s) for s in self.shingles[item]]
            question = self.questions[item]
            shares = [sum(x) / len(x) if x else 1.0 for x in (hits, hits[:question], hits[question:])]
            if shares[0] >= SIMILARITY and min(shares[1:]) >= PART:
                found.append((item, score, *shares))
        return found


def _codes(ids: np.ndarray) -> np.ndarray:
    """A hash of the ``SHINGLE`` numbers from each place on."""
    n = max(0, len(ids) - SHINGLE + 1)
    value = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        value = (value ^ ids[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value


def _has(words: list[str], run: tuple[str, ...]) -> bool:
    return any(tuple(words[i : i + len(run)]) == run for i in range(len(words) - len(run) + 1))


def _index_parts(benchmark: DataFrame, id_column: str, text_column: str, answer_column: str | None):
    """The indexes, one for each part of the items."""
    answer = F.coalesce(F.col(answer_column), F.lit("")) if answer_column else F.lit("")
    rows = benchmark.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"), answer.alias("answer"))
    kind = benchmark.schema[id_column].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> dict:
        made = {"id": batch.column("id"), "words": [], "answer_shingles": [], "size": []}
        for text, own in zip(batch.column("text").to_pylist(), batch.column("answer").to_pylist(), strict=True):
            answer = words_of(own.lower())
            words = words_of(text.lower()) + answer
            n = len(answer) if answer_column else round(ANSWER * len(words))
            made["words"].append(words)
            made["answer_shingles"].append(max(0, min(n, len(shingles(words)) - 1)))
            made["size"].append(len(text) + len(own))
        return made

    items = map_texts(rows, "text", f"id {kind}, words array<string>, answer_shingles int, size long", cut).where(F.size("words") > 0)
    items = written(items.withColumn("row", F.monotonically_increasing_id()), "items")
    total, mean, size = items.agg(F.count("*"), F.avg(F.size("words")), F.sum("size")).first()
    frequency = written(items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").cast("int").alias("n")), "frequency")
    parts = -(-(size or 0) // PART_BYTES)
    for part in range(parts):  # each part has a bounded size
        own = items.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part)
        words = own.select(F.explode("words").alias("word")).distinct().join(frequency, "word")
        known = dict(zip(*(c.to_pylist() for c in words.toArrow().columns), strict=True))
        yield Index(own.orderBy("row").drop("row").toArrow().to_pylist(), known, total, mean)


def contamination(df: DataFrame, benchmark: DataFrame, columns: list[str], text_column: str = "text", item_id: str = "item_id", item_text: str = "text", answer_column: str | None = None) -> DataFrame:
    """A row for each row of ``df`` and item in it: ``columns``, the item's id, ``score`` and overlaps."""
    spark = df.sparkSession
    rows = df.where(F.col(f"`{text_column}`").isNotNull())
    schema = StructType([StructField(item_id, benchmark.schema[item_id].dataType), *StructType.fromDDL("score double, overlap double, question_overlap double, answer_overlap double")])
    found = None
    for index in _index_parts(benchmark, item_id, item_text, answer_column):
        shared = spark.sparkContext.broadcast(index)

        def work(batch: pa.RecordBatch, own: Index) -> dict | None:
            which, rest = [], []
            texts = [words_of(t.lower()) for t in texts_of(batch, "text")]
            for i, (begins, whole) in enumerate(zip(own.promising(texts), own.whole(texts), strict=True)):
                for hit in own.matches(texts[i], begins, whole) if len(begins) or whole else ():
                    which.append(i)
                    rest.append(hit)
            if not which:
                return None
            names = ("score", "overlap", "question_overlap", "answer_overlap")
            return {"rows": which, item_id: [own.ids[r[0]] for r in rest]} | {n: [r[k + 1] for r in rest] for k, n in enumerate(names)}

        part = beside(rows, columns, text_column, schema, work, lambda shared=shared: shared.value, PORTION)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = beside(rows.limit(0), columns, text_column, schema, lambda batch: None)
    return found


def clean(df: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``df`` without the rows that hold an item."""
    row = new_column(df, "__row")
    numbered = written(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    leaks = contamination(numbered, benchmark, [row], text_column, item_id, item_text).select(row).distinct()
    return numbered.join(leaks, row, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
