"""SimHash near-duplicates by tiled exact comparison.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; each shingle of ``words`` words
votes with the bits of its XXH64 (seed 42), and a fingerprint bit is set if over half the shingles
set it. Fingerprints link at ``radius`` or fewer differing bits; what links connect is a component.

Distinct fingerprints are packed into tiles of equal population counts of their four 16-bit
quarters. Two fingerprints within the radius differ by no more than it in those counts summed, so
only tile pairs that near are compared; each compared pair of tiles is one exclusive-or with a bit
count over the whole rectangle. A tile pair returns a forest of its links, no more rows than it has
fingerprints, with at most three links for each at a time.

Null, empty and blank texts have the fingerprint zero and link like any other; texts of fewer words
than a shingle are one shingle. Repeated rows and ties share a component. An empty table gives an
empty result. Components are named by their smallest id; null ids don't count for that.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import Scratch, apart, batch_rows, connected, fresh_path, hand_back, map_texts, row_set, texts_of, written
from portcullis.llm.shared_files import mapped, packed, put, unpacked

SEED = 42
QUARTERS, QUARTER_BITS = 4, 16
#: Fingerprints in a tile, about; larger cells are cut into several tiles.
TILE = 2048


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle; none for a text without words."""
    found = text.lower().split()
    if len(found) < words:
        shingles: Iterable[bytes] = [b" ".join(found)] if found else []
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in shingles), np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that over half the hashes set, as one integer; zero for no hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0]


def fingerprint(text: str, words: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    return int(majority(shingle_hashes(text.encode(), words)))


def fingerprints(df: DataFrame, columns: list[str], text_column: str = "text", words: int = 3) -> DataFrame:
    """``columns`` of ``df`` and ``fp``, a fingerprint for each row."""
    rows = df.select(*columns, F.col(text_column).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", fp long"
    work = lambda batch: {c: batch.column(c) for c in columns} | {"fp": [fingerprint(t, words) for t in texts_of(batch, "__text")]}
    return map_texts(rows, "__text", schema, work)


def _near(radius: int) -> list[list[int]]:
    """Steps from a cell to itself and to those after it whose counts differ by the radius at most."""
    side = QUARTER_BITS + 1
    steps = itertools.product(range(-radius, radius + 1), repeat=QUARTERS)
    return [
        [*step] for step in steps if sum(map(abs, step)) <= radius and sum(x * side ** (QUARTERS - 1 - i) for i, x in enumerate(step)) >= 0
    ]


def _tree(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members: each to the one at half its place."""
    at = np.arange(1, len(members))
    return members[at], members[(at - 1) // 2]


def compare(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two tiles (or within one, if ``right`` is None)."""
    i, j = np.nonzero(np.bitwise_count(left[:, None] ^ (left if right is None else right)[None, :]) <= radius)
    return _forest(left, right, i, j)


def _forest(left: np.ndarray, right: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links between places i and j, thinned to a forest of names."""
    if right is None:
        i, j = i[i < j], j[i < j]
        every = left
    else:
        j = j + len(left)
        every = np.concatenate([left, right])
    if not len(i):
        return every[:0], every[:0]
    label = np.arange(len(every))
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    nodes = np.unique(np.concatenate([i, j]))
    nodes = nodes[np.argsort(label[nodes], kind="stable")]
    cuts = np.flatnonzero(np.diff(label[nodes])) + 1
    trees = [_tree(every[x]) for x in np.split(nodes, cuts)]
    return np.concatenate([a for a, _ in trees]), np.concatenate([b for _, b in trees])


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that connect just those fingerprints of ``distinct`` (fp) that chains of links do."""
    side = QUARTER_BITS + 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", QUARTER_BITS * (QUARTERS - 1 - i)).bitwiseAND(0xFFFF)) for i in range(QUARTERS)]
    code = lambda parts: sum((p * side ** (QUARTERS - 1 - i) for i, p in enumerate(parts)), F.lit(0))
    cells = distinct.select("fp", F.array(*counts).alias("counts")).withColumn("cell", code([F.col("counts")[i] for i in range(QUARTERS)]))
    # At most 17^4 cells, whatever the number of fingerprints.
    sizes = written(cells.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")), "cells")
    placed = cells.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
    tiles = written(placed.groupBy("cell", "block").agg(F.first("counts").alias("counts"), F.collect_list("fp").alias("fps")), "tiles")
    steps = F.array(*[F.array(*map(F.lit, step)) for step in _near(radius)])
    near = [F.col("counts")[i] + F.col("step")[i] for i in range(QUARTERS)]
    inside = [x.between(0, QUARTER_BITS) for x in near]
    pairs = (
        tiles.withColumn("step", F.explode(steps))
        .where(inside[0] & inside[1] & inside[2] & inside[3])
        .select(F.col("cell").alias("from_cell"), F.col("block").alias("from_block"), F.col("fps").alias("left"), code(near).alias("cell"))
        .join(F.broadcast(sizes), "cell")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("cell <> from_cell or block >= from_block")
        .join(tiles.select("cell", "block", F.col("fps").alias("right")), ["cell", "block"])
        .select(F.expr("cell = from_cell and block = from_block").alias("same"), "left", "right")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            same = batch.column("same").to_pylist()
            both = []
            for name in ("left", "right"):
                column = batch.column(name)
                offsets = column.offsets.to_numpy()
                both.append((column.values.to_numpy().view(np.uint64), offsets))
            for k, own in enumerate(same):
                left, right = (values[offsets[k] : offsets[k + 1]] for values, offsets in both)
                found.append(compare(left, None if own else right, radius))
            if found:
                a, b = (np.concatenate([x[side] for x in found]).view(np.int64) for side in (0, 1))
                yield pa.record_batch({"a": a, "b": b})

    return pairs.mapInArrow(run, "a long, b long")


def components(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """A row for each row of ``df``: its id, ``fp`` and ``component_id``."""
    marked = written(fingerprints(df, [id_column], text_column, words), "fingerprints")
    return _joined(marked, id_column, radius)


def _joined(marked: DataFrame, id_column: str, radius: int) -> DataFrame:
    distinct = written(marked.groupBy("fp").agg(F.min(id_column).alias("least")), "distinct")
    roots = connected(links(distinct, radius))
    rooted = written(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "component_id"), "fp")


#: For similarity, fingerprints of LANES words. Texts of Jaccard similarity 0.8 differ in 39 bits on
#: average (an angle of 0.15 of a half turn) with a deviation of 6, and in 10 of the first word with one
#: of 3; a text of four shingles and one with a fifth differ in 48 and 12. Pairs within WIDE_RADIUS
#: and FIRST are candidates, which misses fewer than one pair of 0.8 in some ten thousand even then;
#: what links is decided by the shingles themselves.
LANES, WIDE_RADIUS, FIRST = 4, 76, 26
SIMILARITY = 0.8
#: Shingles in a tile, about; tiles of long texts hold fewer texts.
TILE_SHINGLES = 2 << 20
#: Texts compressed together.
PACK = 32
_MIX = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def wide_fingerprint(text: str, words: int) -> tuple[bytes, int, int]:
    """A fingerprint of LANES words, each with a mix of the hashes of its own; how many shingles differ; and a hash of their set."""
    hashes = np.unique(shingle_hashes(text.encode(), words))
    lanes = []
    for odd in _MIX:
        mixed = hashes * np.uint64(odd)
        lanes.append(majority(mixed ^ mixed >> np.uint64(32) if odd > 1 else mixed))
    return np.array(lanes, "<i8").tobytes(), len(hashes), int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def candidates(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two tiles (or within one, if ``right`` is None) whose fingerprints are near, in the order of the left ones."""
    other = left if right is None else right
    i, j = np.nonzero(np.bitwise_count(left[:, None, 0] ^ other[None, :, 0]) <= FIRST)
    if right is None:
        i, j = i[i < j], j[i < j]
    near = np.bitwise_count(left[i] ^ other[j]).sum(1) <= WIDE_RADIUS
    return i[near], j[near]


def verified(i: np.ndarray, j: np.ndarray, left: list[np.ndarray], right: list[np.ndarray] | None) -> tuple[list[int], list[int]]:
    """Of the candidates as many pairs of Jaccard similarity ``SIMILARITY`` as connect all that such pairs connect.

    ``left`` and ``right`` give the set of shingles at a place. A pair whose ends are connected already
    isn't compared, so a group of near copies takes about as many comparisons as it has texts.
    """
    shift = 0 if right is None else len(left)
    used = np.unique(np.concatenate([i, j + shift]))
    sets = [left[u] if u < len(left) else right[u - len(left)] for u in used.tolist()]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    mark = np.zeros(max((int(c.max()) + 1 for c in codes if len(c)), default=1), bool)
    label = np.arange(len(used))
    a, b = np.searchsorted(used, i), np.searchsorted(used, j + shift)
    rows = np.flatnonzero(np.diff(a, prepend=-1))
    found: tuple[list[int], list[int]] = ([], [])
    for begin, end in zip(rows.tolist(), [*rows[1:].tolist(), len(a)], strict=True):
        one, others = int(a[begin]), b[begin:end]
        n, own = sizes[others], sizes[one]
        able = (label[others] != label[one]) & (np.minimum(n, own) >= SIMILARITY * np.maximum(n, own) - 1e-9) & (n > 0)
        others = others[able]
        mark[codes[one]] = True
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            some = some[label[some] != label[one]]
            if not len(some):
                continue
            n = sizes[some]
            common = np.add.reduceat(mark[np.concatenate([codes[x] for x in some.tolist()])], np.cumsum(n) - n, dtype=np.int64)
            for other in some[common >= SIMILARITY * (n + own - common) - 1e-9].tolist():
                if label[other] != label[one]:
                    label[label == label[other]] = label[one]
                    found[0].append(int(used[one]))
                    found[1].append(int(used[other]) - shift)
        mark[codes[one]] = False
    return found


def similar_links(distinct: DataFrame, texts: Callable[[DataFrame], DataFrame], scratch: Scratch, words: int = 5) -> DataFrame:
    """(a, b): links that connect the ids of ``distinct`` (id, row, shingles) that pairs of similarity 0.8 do.

    Such texts have numbers of shingles within that ratio, so tiles hold texts of about one number, and
    only tiles of one step of the ratio or the next are compared. ``texts`` gives such rows with their
    texts, which go to their tiles in one shuffle. A tile's texts are a compressed file in the shared
    folder; only those of candidates are cut into shingles again.
    """
    spark = distinct.sparkSession
    folder = fresh_path(spark, "texts-of-tiles")
    scratch.paths.append(folder)
    # A little over the ratio, so that rounding keeps no pair two steps apart.
    step = F.floor(F.log(F.greatest("shingles", F.lit(1)).cast("double")) / (-np.log(SIMILARITY) * 1.0001)).cast("int")
    # At most some two hundred steps, whatever the lengths of texts.
    most = F.greatest(F.count("*") / TILE, F.sum("shingles") / TILE_SHINGLES)
    sizes = scratch.written(distinct.where("shingles > 0").groupBy(step.alias("step")).agg(F.ceil(most).cast("int").alias("blocks")), "steps")
    stepped = texts(distinct.where("shingles > 0")).withColumn("step", step)
    placed = stepped.join(F.broadcast(sizes), "step").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def tile(table: pa.Table) -> pa.Table:
        key = {c: table.column(c)[0].as_py() for c in ("step", "block")}
        squeeze = zstandard.ZstdCompressor(3).compress
        texts = [t.encode() for t in table.column("text").to_pylist()]
        packs = [squeeze(b"".join(texts[at : at + PACK])) for at in range(0, len(texts), PACK)]
        sizes, ends = (np.fromiter(x, np.int64) for x in (map(len, texts), itertools.accumulate(map(len, packs))))
        put(f"{folder}/{key['step']}-{key['block']}", packed({"sizes": sizes, "ends": ends, "packs": np.frombuffer(b"".join(packs), np.uint8)}))
        ids = table.column("id").to_numpy().astype("<i8").tobytes()
        del texts, packs
        hand_back()
        return pa.table({"step": pa.array([key["step"]], pa.int32()), "block": pa.array([key["block"]], pa.int32()), "ids": [ids], "bits": [b"".join(table.column("bits").to_pylist())]})

    packed_tiles = placed.select("step", "block", "id", "bits", "text").groupBy("step", "block").applyInArrow(tile, "step int, block int, ids binary, bits binary")
    tiles = scratch.written(packed_tiles, "wide-tiles")
    pairs = (
        tiles.select(F.col("step").alias("from_step"), F.col("block").alias("from_block"), F.col("ids").alias("left_ids"), F.col("bits").alias("left_bits"), F.explode(F.array("step", F.col("step") + 1)).alias("step"))
        .join(F.broadcast(sizes), "step")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("step <> from_step or block >= from_block")
        .join(tiles.select("step", "block", F.col("ids").alias("right_ids"), F.col("bits").alias("right_bits")), ["step", "block"])
    )

    def sets_of(step: int, block: int, places: np.ndarray, total: int) -> list[np.ndarray | None]:
        arrays, _ = unpacked(mapped(f"{folder}/{step}-{block}"))
        loose = zstandard.ZstdDecompressor().decompress
        sets: list[np.ndarray | None] = [None] * total
        for pack, own in itertools.groupby(np.unique(places).tolist(), lambda p: p // PACK):
            whole = loose(arrays["packs"][arrays["ends"][pack - 1] if pack else 0 : arrays["ends"][pack]].tobytes())
            ends = np.cumsum(arrays["sizes"][pack * PACK : (pack + 1) * PACK]).tolist()
            for p in own:
                at = p % PACK
                sets[p] = np.unique(shingle_hashes(whole[ends[at - 1] if at else 0 : ends[at]], words))
        return sets

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["step"] == row["from_step"] and row["block"] == row["from_block"]
                (left_ids, left), (right_ids, right) = ((np.frombuffer(row[f"{s}_ids"], "<i8"), np.frombuffer(row[f"{s}_bits"], "<u8").reshape(-1, LANES)) for s in ("left", "right"))
                i, j = candidates(left, None if same else right)
                if not len(i):
                    continue
                left_sets = sets_of(row["from_step"], row["from_block"], np.concatenate([i, j]) if same else i, len(left))
                a, b = verified(i, j, left_sets, None if same else sets_of(row["step"], row["block"], j, len(right)))
                yield pa.record_batch({"a": pa.array(left_ids[a], pa.int64()), "b": pa.array(right_ids[b], pa.int64())})
                del left_sets
                hand_back()

    return pairs.mapInArrow(run, "a long, b long")


def dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5) -> DataFrame:
    """``df`` with one row of each group of near copies: that of the smallest id (nulls last, then any one).

    As elsewhere for near-duplicates, shingles have five words and texts link at a Jaccard similarity of
    their sets of 0.8: fingerprints find the candidates, the sets are then compared.
    """
    scratch = Scratch(df.sparkSession)
    batch_rows(df.sparkSession)
    row, found = apart(df.columns, ["row", "found"])

    @F.arrow_udf("struct<bits binary, shingles int, node long>")
    def marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            bits, shingles, node = zip(*(wide_fingerprint(t.as_py() or "", words) for t in texts), strict=True) if len(texts) else ([], [], [])
            yield pa.StructArray.from_arrays([pa.array(bits, pa.binary()), pa.array(shingles, pa.int32()), pa.array(node, pa.int64())], names=["bits", "shingles", "node"])

    text = F.col(f"`{text_column}`")
    numbered = written(df.withColumns({row: F.monotonically_increasing_id(), found: marks(text)}), "numbered")
    rows = numbered.select(F.col(f"`{row}`").alias("row"), F.col(f"`{id_column}`").alias("id"), text.alias("text"), F.col(f"`{found}`.bits").alias("bits"), F.col(f"`{found}`.shingles").alias("shingles"), F.col(f"`{found}`.node").alias("node"))
    one = F.min(F.struct("row", "shingles")).alias("one")
    distinct = scratch.written(rows.groupBy("node").agg(one).select(F.col("node").alias("id"), "one.*"), "distinct")

    def texts(chosen: DataFrame) -> DataFrame:
        held = row_set(chosen.select("row"), "chosen", scratch)
        return rows.where(held("row")).select(F.col("node").alias("id"), "bits", "shingles", "text")

    roots = connected(similar_links(distinct, texts, scratch, words), scratch)
    joined = rows.select("row", "id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    kept = joined.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    held = row_set(kept, "kept")
    scratch.clear()
    return numbered.where(held(F.col(f"`{row}`"))).select(*[F.col(f"`{c}`") for c in df.columns])
