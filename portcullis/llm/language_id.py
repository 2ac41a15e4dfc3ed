"""Language identification by language-bitmask n-gram filters.

``train`` counts the n-grams of letters in the labelled texts and decides for each n-gram which
languages contain it: those whose share of it is at least ``near`` of the largest share. The masks
go into a bit-sliced Bloom filter: ``SLICES`` arrays of language masks, of twice as many positions as
there are n-grams, or more, so that at most half of each is filled. The filter is a file in the shared
folder that tasks map. A look-up ands one mask from each array and so returns all languages of an n-gram at once. ``predict`` counts each
language's n-grams in a text, takes off what the filter's fill leads one to expect by chance, and
names the language with the most; its share of the text's n-grams is the score.

Null texts and texts without a letter are ``und`` with score 0, as is every text where nothing was
learned. A text with letters but no known n-gram has the language with the most n-grams in training,
with score 0. Ties go to the language that sorts first. Only the text is
looked at in a prediction. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import apart, batch_rows, fresh_path, map_texts, new_column, text_portions, texts_of, written
from portcullis.llm.shared_files import mapped, put

GRAM = 4
#: Bytes of text that are looked at together, and characters of them whose n-grams are.
PORTION, WINDOW = 1 << 20, 1 << 18
#: The filter: its arrays, the positions of each at least, and those that a file of it has at most.
SLICES, POSITIONS, PIECE = 3, 1 << 18, 1 << 20
#: Languages in a mask column; more languages take more columns.
WORD = 62
UNKNOWN = "und"
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter (of the basic plane and beyond)."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The texts' n-grams, and who has letters. The n-grams come a window of ``WINDOW`` characters at a
    time, whatever the lengths of the texts: their hashes, and the text that each is of.

    A text is lower-cased and put between spaces; what is no letter counts as a space, and n-grams
    with spaces side by side are left out.
    """
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lengths = np.fromiter(map(len, points), np.int64, len(points))
    every = np.concatenate([*points, np.full(GRAM, 32, "<u4")])
    del points
    is_letter = _is_letter()
    ends = np.cumsum(lengths)
    total = int(lengths.sum())
    letters = np.zeros(len(texts), bool)
    for at in range(0, total, WINDOW):
        hit = np.flatnonzero(is_letter[every[at : min(at + WINDOW, total)]]) + at
        letters[np.searchsorted(ends, hit, "right")] = True

    def windows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # Texts stand side by side between spaces, so no n-gram with two letters apart runs into the next.
        for at in range(0, total, WINDOW):
            n = min(WINDOW, total - at)
            part = every[at : at + n + GRAM]
            letter = is_letter[part]
            part = np.where(letter, part, 32).astype(np.uint64)
            twice = ~letter[:-1] & ~letter[1:]
            ok = np.ones(n, bool)
            for i in range(GRAM - 1):
                ok &= ~twice[i : n + i]
            value = np.zeros(n, np.uint64)
            for i in range(GRAM):
                value = value * np.uint64(0x100000001B3) + part[i : n + i]
            place = np.flatnonzero(ok)
            yield value[place], np.searchsorted(ends, place + at, "right")

    return windows(), letters


def _positions(value: np.ndarray, positions: int) -> list[np.ndarray]:
    bits = positions.bit_length() - 1
    return [(value * np.uint64(m) >> np.uint64(64 - bits)).astype(np.int64) for m in _MIX]


@dataclass
class Model:
    languages: list[str]
    #: Where the filter's files are: of each slice and word, pieces of the language masks of a position, as bits.
    folder: str
    #: Positions of a slice, a power of two.
    positions: int
    #: By language, the chance that the filter has an n-gram that the language lacks.
    chance: list[float]
    #: The place of the language with the most n-grams.
    usual: int = 0

    def words(self) -> int:
        return -(-len(self.languages) // WORD)

    def masks(self) -> list[list[list[np.ndarray]]]:
        """[slice][word][piece]: the masks, mapped into memory."""
        pieces = range(-(-self.positions // PIECE))
        return [[[mapped(f"{self.folder}/{s}-{w}-{p}").view("<i8") for p in pieces] for w in range(self.words())] for s in range(SLICES)]

    def predict(self, texts: list[str | None], masks: list[list[list[np.ndarray]]]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        windows, letters = grams([t or "" for t in texts])
        n, found = np.zeros(len(texts)), np.zeros((len(self.languages), len(texts)))
        for value, owner in windows:
            at = _positions(value, self.positions)
            n += np.bincount(owner, minlength=len(texts))
            for w in range(self.words()):
                word = np.bitwise_and.reduce([_taken(masks[s][w], at[s]) for s in range(SLICES)])
                for i in range(w * WORD, min((w + 1) * WORD, len(self.languages))):
                    found[i] += np.bincount(owner[(word >> (i % WORD) & 1).astype(bool)], minlength=len(texts))
        chance = np.array(self.chance)[:, None]
        share = np.clip((found - n * chance) / (np.maximum(n, 1) * np.maximum(1e-9, 1 - chance)), 0, 1)
        best = share.argmax(0)
        score = share.max(0)
        best = np.where(score > 0, best, self.usual)
        named = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), letters.tolist(), strict=True)]
        return named, np.where(letters, score, 0.0).tolist()


def _taken(pieces: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    if len(pieces) == 1:
        return pieces[0][at]
    found = np.zeros(len(at), np.int64)
    for p, piece in enumerate(pieces):
        own = at // PIECE == p
        found[own] = piece[at[own] % PIECE]
    return found


def held_out(id_column: str, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % parts == part


def train(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", near: float = 0.25, least: int = 2) -> Model:
    """The filter of all rows with a text and a language.

    An n-gram counts for a language that has it ``least`` times and at ``near`` of the share of the
    language where it is most frequent; texts with passages in other languages do no harm so.
    """
    rows = labelled.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("text is not null and lang is not null")

    def count(batch: pa.RecordBatch) -> dict:
        langs = np.array(batch.column("lang").to_pylist())
        texts = np.array(texts_of(batch, "text"), object)
        found = []
        for lang in sorted(set(langs.tolist())):
            parts = [np.unique(value, return_counts=True) for value, _ in grams(texts[langs == lang].tolist())[0]]
            value, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            times = np.bincount(back, np.concatenate([p[1] for p in parts]), len(value)).astype(np.int64)
            found.append((value, np.full(len(value), lang, object), times))
        value, lang, times = (np.concatenate([x[i] for x in found]) for i in range(3))
        return {"gram": value.view(np.int64), "lang": lang.tolist(), "times": times}

    counted = written(
        map_texts(rows, "text", "gram long, lang string, times long", count, most=PORTION).groupBy("gram", "lang").agg(F.sum("times").alias("times")), "grams"
    )
    totals = counted.groupBy("lang").agg(F.sum("times").alias("total")).orderBy("lang").collect()  # a row for each language
    languages = [r["lang"] for r in totals]
    if not languages:
        return Model([], "", POSITIONS, [])
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for r, v in zip(totals, values, strict=True) for x in (r["lang"], v)]), F.col("lang"))
    shares = counted.where(F.col("times") >= least).withColumn("share", F.col("times") / pick([r["total"] for r in totals]))
    top = shares.groupBy("gram").agg(F.collect_list(F.struct("share", pick(range(len(languages))).alias("i"))).alias("langs"), F.max("share").alias("top"))
    words = -(-len(languages) // WORD)
    kept = F.expr(f"filter(langs, x -> x.share >= {near} * top)")
    mask = lambda w: F.aggregate(
        F.filter(kept, lambda x: F.floor(x.i / WORD) == w), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (x.i % WORD).cast("int")))
    )
    masked = written(top.select("gram", *[mask(w).alias(f"w{w}") for w in range(words)]), "masked")
    positions = max(POSITIONS, 1 << (2 * masked.count() - 1).bit_length())

    def place(batches):
        for batch in batches:
            value = batch.column("gram").to_numpy().view(np.uint64)
            for s, at in enumerate(_positions(value, positions)):
                yield pa.record_batch([pa.array(np.full(len(at), s, np.int32)), pa.array(at), *batch.columns[1:]], names=["slice", "at", *batch.schema.names[1:]])

    slots = (
        masked.mapInArrow(place, "slice int, at long, " + ", ".join(f"w{w} long" for w in range(words)))
        .groupBy("slice", "at")
        .agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)])
        .withColumn("piece", F.floor(F.col("at") / PIECE).cast("int"))
    )
    size, folder = min(PIECE, positions), fresh_path(labelled.sparkSession, "languages")

    def write(table: pa.Table) -> pa.Table:
        s, p = (table.column(c)[0].as_py() for c in ("slice", "piece"))
        filled = []
        for w in range(words):
            masks = np.zeros(size, "<i8")
            masks[table.column("at").to_numpy() % PIECE] = table.column(f"w{w}").to_numpy()
            put(f"{folder}/{s}-{w}-{p}", masks.tobytes())
            filled += [int((masks >> i & 1).sum()) for i in range(min(WORD, len(languages) - w * WORD))]
        return pa.table({"slice": pa.array([s], pa.int32()), "piece": pa.array([p], pa.int32()), "filled": pa.array([filled], pa.list_(pa.int64()))})

    # A row for each million positions; a piece without any n-gram is empty.
    made = slots.groupBy("slice", "piece").applyInArrow(write, "slice int, piece int, filled array<long>").collect()
    for s, p in {(s, p) for s in range(SLICES) for p in range(-(-positions // PIECE))} - {(r["slice"], r["piece"]) for r in made}:
        for w in range(words):
            put(f"{folder}/{s}-{w}-{p}", bytes(8 * size))
    fill = np.zeros((SLICES, len(languages)))
    for r in made:
        fill[r["slice"]] += np.array(r["filled"]) / positions
    usual = max(range(len(languages)), key=lambda i: totals[i]["total"])
    return Model(languages, folder, positions, fill.prod(0).tolist(), usual)


def predict(df: DataFrame, model: Model, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` of ``df``, ``lang_pred`` and ``score`` for each row (with underscores, where ``columns`` has
    such names). The columns stay with Spark: only the texts go to Python."""
    batch_rows(df.sparkSession)
    found = _named(model)(F.col(f"`{text_column}`"))
    kept = [F.col(f"`{c}`") for c in columns]
    names = apart(columns, ["lang_pred", "score"])
    marked = df.select(*kept, found.alias(new_column(df, "found")))
    last = F.col(f"`{marked.columns[-1]}`")
    return marked.select(*kept, last["lang_pred"].alias(names[0]), last["score"].alias(names[1]))


def _named(model: Model):
    """An Arrow UDF: text to (lang_pred, score)."""

    @F.arrow_udf("struct<lang_pred string, score double>")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        masks = model.masks()
        for texts in batches:
            lang, score = [], []
            for part in text_portions([pa.record_batch([texts], names=["text"])], "text", PORTION):
                one, two = model.predict(part.column(0).to_pylist(), masks)
                lang += one
                score += two
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return named
