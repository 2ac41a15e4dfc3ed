"""Alignment of the tokens of two tokenizers over the same bytes, with corpus-wide link counts.

Side A is a byte-level tokenizer file, which gets a space and the text; side B is a SentencePiece
model, which adds that space itself. Byte offsets where a token of both sides ends cut the tokens into
groups, and the two tokens that end there are linked. How often a pair of ids is linked is counted
over the whole corpus: each task adds its own links up, the sums are partitioned by stripes of B's ids,
and a stripe's task adds them into a dense matrix (ids of the stripe x ids of A), whose row maxima tell
the best partners of each B id. The links themselves are partitioned by the same stripes, beside which
the counts stand, and what each document's links score there is added up by document.

Texts are tokenized once; their packed links are a table in the shared folder. A stripe's links go to
several tasks if it has many (a frequent id may hold any share of them); its counts, bounded by the
vocabularies, are repeated for each of these. No id, link or document is dropped.

Null and empty texts, and those that a side doesn't give back byte for byte (B may normalise), have no
tokens: zeros, and '' as groups. Texts that occur again count each time. Extra columns pass through; a
result whose name they have already gets underscores. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from portcullis.llm.common import apart, batch_rows, beside, kept, text_portions, written

#: B ids of a stripe; links that a task scores together; pairs and links that a task holds while it counts.
STRIPE, DEAL, PAIRS, LINKS = 128, 1 << 22, 1 << 21, 1 << 20
#: Bytes of text tokenized together, and of links dealt together.
TEXT_BYTES, LINK_BYTES = 1 << 20, 4 << 20


def byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable bytes stand for themselves, the others for 256 and up."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: How a byte-level tokenizer cuts a text into the words that it merges alone, and the characters whose classes
#: don't depend on the version of Unicode (tested against the library's own cuts).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SETTLED = regex.compile(r"[\x00-\u04FF\u2010-\u2027\u2030-\u205E]*")
#: Words whose ids a task keeps, twice: those met lately, and those met before them.
KEPT_WORDS = 1 << 17


class Words(dict):
    """The ids of words as packed integers, each merged by the library when it is first met."""

    def __init__(self, merges, alphabet: dict[str, int]):
        super().__init__()
        self.merges, self.characters, self.older = merges, [c for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        if (found := self.older.get(word)) is None:
            ids = [t.id for t in self.merges.tokenize("".join(map(self.characters.__getitem__, word.encode())))]
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = found
        return found


class Sides:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, a: str, b: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b)
        alphabet = byte_alphabet()
        # Words apart are what the library does if it cuts by its own pattern and normalises nothing.
        parts = json.loads(a)
        cut = parts["pre_tokenizer"] or {}
        plain = parts["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.words = Words(self.a.model, alphabet) if plain else None
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = [b""] * (1 + max(self.a.get_vocab().values()))
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = entry.encode() if i in added else bytes(alphabet[c] for c in entry)
        pieces = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in pieces)]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.size = max(len(self.bytes_a), len(self.bytes_b))
        self.said = [f"{i}{mark}" for mark in ",|;" for i in range(self.size)]

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """A's ids of a space and each text. A corpus says the same words again and again, so words are merged
        once; texts with characters whose class may be new go to the library whole."""
        found: list = [None] * len(texts)
        for i, text in enumerate(texts):
            if self.words is not None and SETTLED.fullmatch(text):
                found[i] = np.frombuffer(b"".join(map(self.words.__getitem__, WORDS.findall(" " + text))), "<u4")
        whole = [i for i, f in enumerate(found) if f is None]
        for i, e in zip(whole, self.a.encode_batch_fast([" " + texts[i] for i in whole], add_special_tokens=False), strict=True):
            found[i] = np.array(e.ids, "<u4")
        return found

    def align(self, texts: list[str]) -> dict[str, list]:
        """Tokens, groups and links of each text."""
        none = ([], [])
        found = [none] * len(texts)
        asked = [i for i, t in enumerate(texts) if t]
        tokens_a = self.encode_a([texts[i] for i in asked])
        tokens_b = self.b.encode([texts[i] for i in asked], num_threads=1)
        for i, ids, b in zip(asked, tokens_a, tokens_b, strict=True):
            source = b" " + texts[i].encode()
            if b"".join(map(self.bytes_b.__getitem__, b)) == source == b"".join(map(self.bytes_a.__getitem__, ids)):
                found[i] = (ids, b)
        last_a, last_b = (np.cumsum([0, *(len(x[side]) for x in found)]) for side in (0, 1))
        a, b = (np.concatenate([np.zeros(0, np.int64), *[np.array(x[side], np.int64) for x in found]]) for side in (0, 1))
        # All texts behind one another: each ends with a cut, so none goes over two of them.
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        at_a, at_b = np.zeros((2, 1 + int(ends_a[-1]) if len(a) else 1), bool)
        at_a[ends_a] = at_b[ends_b] = True
        cut_a, cut_b = at_b[ends_a], at_a[ends_b]
        linked_a, linked_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        words = np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + np.concatenate([[0], linked_b + 1])[group_a]] = a + self.size * cut_a
        words[np.arange(len(b)) + linked_a[group_b] + 1] = b + 2 * self.size * cut_b
        last = np.searchsorted(linked_a, last_a)
        links = np.stack([a[linked_a], b[linked_b]], 1).astype("<u4")
        return {
            "n_a": np.diff(last_a),
            "n_b": np.diff(last_b),
            "n_groups": np.diff(last),
            "links": [links[i:j].tobytes() for i, j in zip(last[:-1], last[1:], strict=True)],
            "groups": ["".join(map(self.said.__getitem__, words[i:j].tolist()))[:-1] for i, j in zip(last_a[:-1] + last_b[:-1], last_a[1:] + last_b[1:], strict=True)],
        }


def encode(df: DataFrame, a_path: str, b_path: str, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` of ``df`` and beside them ``row`` (a number of its own for each row), ``n_a``, ``n_b``,
    ``n_groups``, ``links`` (binary: A and B id of each link as little-endian unsigned 32-bit integers)
    and ``groups`` (``a1,a2|b1;a3|b2,b3``: A and B ids of each group)."""
    a, b = Path(a_path).read_text(), Path(b_path).read_bytes()

    def work(batch: pa.RecordBatch, sides: Sides) -> dict:
        return {"row": batch.column("row")} | sides.align(batch.column("text").to_pylist())

    return beside(
        df, columns, text_column, "row long, n_a long, n_b long, n_groups long, links binary, groups string",
        work, lambda: kept(("sides", a, b), lambda: Sides(a, b)), TEXT_BYTES, {"row": F.monotonically_increasing_id()},
    )


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the batch, A id and B id of each link."""
    sizes = [len(x) // 8 for x in batch.column("links").to_pylist()]
    pairs = np.frombuffer(b"".join(batch.column("links").to_pylist()), "<u4").astype(np.int64).reshape(-1, 2)
    return np.repeat(np.arange(len(sizes)), sizes), pairs[:, 0], pairs[:, 1]


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


def tallies(encoded: DataFrame) -> DataFrame:
    """Sums that the tasks make of their own links: stripe, and packed pairs (B id << 32 | A id) and counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = np.zeros(0, np.int64)
        waiting, size = [], 0

        def merge() -> None:
            nonlocal keys, counts, waiting, size
            new, n = np.unique(np.concatenate(waiting or [keys[:0]]), return_counts=True)
            every, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            sums = np.zeros(len(every), np.int64)
            np.add.at(sums, place, np.concatenate([counts, n]))
            keys, counts, waiting, size = every, sums, [], 0

        def packed() -> pa.RecordBatch:
            stripe = (keys >> 32) // STRIPE
            at = _runs(stripe)
            spans = list(zip(at[:-1], at[1:], strict=True))
            return pa.record_batch(
                {
                    "stripe": pa.array(stripe[at[:-1]], pa.int32()),
                    "pairs": pa.array([keys[i:j].tobytes() for i, j in spans], pa.binary()),
                    "counts": pa.array([counts[i:j].tobytes() for i, j in spans], pa.binary()),
                }
            )

        for batch in batches:
            for part in text_portions([batch], "links", LINK_BYTES):
                _, a, b = _links(part)
                waiting.append(b << 32 | a)
                size += len(a)
                if size >= LINKS:
                    merge()
                if len(keys) >= PAIRS:
                    yield packed()
                    keys = counts = keys[:0]
        merge()
        yield packed()

    return encoded.select("links").mapInArrow(add, "stripe int, pairs binary, counts binary")


def link_counts(encoded: DataFrame, size_a: int) -> DataFrame:
    """A row for each stripe: its packed pairs (B id << 32 | A id, sorted), their counts over all links,
    whether that is the highest of the B id, and ``total``, the sum of the counts."""

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key[0].as_py() * STRIPE
        block = np.zeros((STRIPE, size_a), np.int64)
        met = np.zeros(0, np.int64)  # cells that aren't zero, so that nothing looks at the others
        for batch in batches:
            pairs, counts = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("pairs", "counts"))
            np.add.at(block, ((pairs >> 32) - first, pairs & 0xFFFFFFFF), counts)
            met = np.union1d(met, pairs)
        b, a = (met >> 32) - first, met & 0xFFFFFFFF
        n, highest = block[b, a], np.zeros(STRIPE, np.int64)
        np.maximum.at(highest, b, n)
        best = n == highest[b]
        columns = [[key[0].as_py()], [met.tobytes()], [n.tobytes()], [best.tobytes()], [int(n.sum())]]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()], strict=True)], ["stripe", "pairs", "counts", "best", "total"])

    return tallies(encoded).groupBy("stripe").applyInArrow(count, "stripe int, pairs binary, counts binary, best binary, total long")


def pair_rows(counts: DataFrame) -> DataFrame:
    """The counts as rows: ``a``, ``b``, ``n_links`` and whether that is the most of ``b``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, n, best in zip(*(batch.column(c).to_pylist() for c in ("pairs", "counts", "best")), strict=True):
                pair = np.frombuffer(pairs, np.int64)
                yield pa.record_batch({"a": pair & 0xFFFFFFFF, "b": pair >> 32, "n_links": np.frombuffer(n, np.int64), "best": np.frombuffer(best, bool)})

    return counts.select("pairs", "counts", "best").mapInArrow(rows, "a long, b long, n_links long, best boolean")


def _dealt(encoded: DataFrame, parts: dict[int, int]) -> DataFrame:
    """Each portion's links by stripe: those of a document and a pair together, sorted by pair."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion in text_portions([batch], "links", LINK_BYTES):
                place, a, b = _links(portion)
                if not len(a):
                    continue
                rows = portion.column("row").to_numpy()
                order = np.lexsort((place, a, b))
                place, a, b = place[order], a[order], b[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)]))
                n = np.diff(np.concatenate([new, [len(a)]]))
                place, a, b = place[new], a[new], b[new]
                at = _runs(b // STRIPE)
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                stripes = (b[at[:-1]] // STRIPE).tolist()
                number = int(rows[0])
                yield pa.record_batch(
                    {
                        "stripe": pa.array(stripes, pa.int32()),
                        # A hash of the portion's number picks the part; consecutive numbers spread.
                        "part": pa.array([(number * 0x9E3779B1 >> 7) % parts[s] for s in stripes], pa.int32()),
                        "portion": pa.array([number] * len(spans), pa.int64()),
                        "rows": pa.array([rows[np.unique(place[i:j])].tobytes() for i, j in spans], pa.binary()),
                        "places": pa.array([np.unique(place[i:j], return_inverse=True)[1].astype("<u4").tobytes() for i, j in spans], pa.binary()),
                        "a": pa.array([a[i:j].astype("<u4").tobytes() for i, j in spans], pa.binary()),
                        "b": pa.array([(b[i:j] % STRIPE).astype("u1").tobytes() for i, j in spans], pa.binary()),
                        "n": pa.array([n[i:j].astype("<u4").tobytes() for i, j in spans], pa.binary()),
                    }
                )

    return encoded.where("n_groups > 0").select("row", "links").mapInArrow(deal, "stripe int, part int, portion long, rows binary, places binary, a binary, b binary, n binary")


def scores(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """``row``, ``n_best`` (links whose count is the highest of their B id) and ``count_sum`` of rows with links."""
    # A row for each stripe at most: bounded by B's vocabulary.
    parts = {r["stripe"]: -(-r["total"] // DEAL) for r in counts.select("stripe", "total").collect()}
    beside_links = counts.withColumn("part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("total") / DEAL) - 1).cast("int"))))
    packed = "portion long, rows binary, best binary, sums binary"

    def score(links: pa.Table, known: pa.Table) -> pa.Table:
        made = {"portion": links.column("portion"), "rows": links.column("rows"), "best": [], "sums": []}
        if links.num_rows:
            pairs = np.frombuffer(known.column("pairs")[0].as_py(), np.int64)
            count = np.frombuffer(known.column("counts")[0].as_py(), np.int64)
            best = np.frombuffer(known.column("best")[0].as_py(), bool)
            first = links.column("stripe")[0].as_py() * STRIPE
            for i in range(links.num_rows):
                rows, place, a, b, n = (np.frombuffer(links.column(c)[i].as_py(), t) for c, t in (("rows", np.int64), ("places", "<u4"), ("a", "<u4"), ("b", "u1"), ("n", "<u4")))
                at = np.searchsorted(pairs, (b.astype(np.int64) + first) << 32 | a)
                sums = np.zeros((2, len(rows)), np.int64)
                np.add.at(sums[0], place, n * best[at])
                np.add.at(sums[1], place, n * count[at])
                made["best"].append(sums[0].tobytes())
                made["sums"].append(sums[1].tobytes())
        return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v, pa.binary()) for k, v in made.items()})

    def add(records: pa.Table) -> pa.Table:
        """A portion's sums: a few thousand rows from each stripe at most."""
        rows, best, sums = (np.frombuffer(b"".join(records.column(c).to_pylist()), np.int64) for c in ("rows", "best", "sums"))
        row, place = np.unique(rows, return_inverse=True)
        total = np.zeros((2, len(row)), np.int64)
        np.add.at(total[0], place, best)
        np.add.at(total[1], place, sums)
        return pa.table({"row": row, "n_best": total[0], "count_sum": total[1]})

    dealt = _dealt(encoded, parts).groupBy("stripe", "part")
    scored = dealt.cogroup(beside_links.groupBy("stripe", "part")).applyInArrow(score, packed)
    return scored.groupBy("portion").applyInArrow(add, "row long, n_best long, count_sum long")


def align(df: DataFrame, a_path: str, b_path: str, columns: list[str], text_column: str = "text", groups: Callable[[Column], Column] = lambda g: g) -> DataFrame:
    """``columns`` of ``df``, and ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and
    ``groups``, of which a caller may keep less than the whole (``groups``: a function of the column)."""
    from tokenizers import Tokenizer

    batch_rows(df.sparkSession)
    found = encode(df, a_path, b_path, columns, text_column)
    own = found.columns[len(columns) :]  # row, n_a, n_b, n_groups, links, groups, or with underscores
    names = ["row", "n_a", "n_b", "n_groups", "links", "groups"]
    inner = [f"c{i}" for i in range(len(columns))]
    encoded = written(found.toDF(*inner, *names).withColumn("groups", groups(F.col("groups"))), "aligned")
    counts = written(link_counts(encoded, 1 + max(Tokenizer.from_file(a_path).get_vocab().values())), "link-counts")
    results = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    whole = encoded.join(scores(encoded, counts), "row", "left").withColumn("n_links", F.col("n_groups"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select(*inner, *[zero(c) if c != "groups" else F.col(c) for c in results]).toDF(*columns, *apart(columns, results))
