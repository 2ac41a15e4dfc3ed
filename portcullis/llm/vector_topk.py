"""Exact top-k search by inner product over vector-approximation files.

Vectors become whole numbers floor(scale * x), kept as doubles, which hold them exactly. They are packed into blocks; each block also has every
component's cell, one byte, out of ``CELLS`` equal cells between the component's least and greatest
value over the table. A search scans a block's cells first: the middle and the half width of a
vector's cells bound its inner product with the query. Exact vectors are then read in the order of
their bounds until the k-th best found is certain: no vector left can reach it.

The queries are a stated set: packed into blocks too, they go to every group of vector blocks, so
the work is a grid of block pairs and only the components' ranges are broadcast. Each pair returns k rows a query at most,
and a ranking window (which limits before its shuffle) takes the best.

Null vectors and those with null or non-finite components take no part, as query or candidate; nor do
empty ones, nor those that scaling takes beyond the doubles. Scores are exact: sums that could leave 64
bits are taken in unbounded integers, and the ranking is by them. Only a score that is returned and that 64
bits can't hold is an error. Vectors of different lengths are not compared. Ties go to the smaller id, null
ids last; of repeated rows each takes part, and a query leaves out its own row alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis.llm.common import batch_rows, written

CELLS = 64
BLOCK, QUERIES = 4096, 256
#: What the bounds allow for rounding, of the sum of absolute products and for each component.
ROUNDING = 2.0**-48
#: Exact vectors read at a time for one query.
READ = 64
#: Rows of blocks that go to Python together, and row groups of their tables: such a row is some MB long.
BLOCK_ROWS = 4
ROW_GROUPS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
PACKED = "dims int, block long, uids binary, ids binary, vectors binary"


def _search(scores_of: Callable[[np.ndarray], np.ndarray], uid: np.ndarray, own_uid: int, upper: np.ndarray, lower: np.ndarray, ids: np.ndarray, k: int):
    """Places and scores of the k best rows of a block for one query."""
    upper = np.where(uid == own_uid, -np.inf, upper)
    lower = np.where(uid == own_uid, -np.inf, lower)
    possible = np.flatnonzero(upper > -np.inf)
    if len(possible) > k:
        sure = np.partition(lower[possible], len(possible) - k)[len(possible) - k]
        possible = possible[upper[possible] >= sure]
    order = possible[np.argsort(-upper[possible], kind="stable")]
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(order), READ):
        if len(scores) >= k and float(upper[order[at]]) < scores[k - 1]:
            break
        some = order[at : at + READ]
        places = np.concatenate([places, some])
        scores = np.concatenate([scores, scores_of(some)])
        best = _best(scores, ids[places])[:k]
        places, scores = places[best], scores[best]
    return places, scores


def _best(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return np.lexsort((ids, -scores))
    return np.array(sorted(range(len(scores)), key=lambda n: (-scores[n], ids[n])), np.int64)


def search_block(queries: np.ndarray, query_uids: np.ndarray, exact: np.ndarray, cells: np.ndarray, least: np.ndarray, most: np.ndarray, uids: np.ndarray, ids: np.ndarray, k: int):
    """(query, place, score) of each query's k best rows in one block."""
    with np.errstate(over="ignore", invalid="ignore"):
        width = (most / 2 - least / 2) / (CELLS / 2)
        middle = least + (cells + 0.5) * width
        size = np.abs(queries)
        largest = size @ (np.maximum(np.abs(least), np.abs(most)) + width)
        at_middle, spread = queries @ middle.T, (size @ (width / 2) + largest * len(least) * ROUNDING)[:, None]
        # Where doubles don't hold the bounds, nothing is bounded.
        upper, lower = np.nan_to_num(at_middle + spread, nan=np.inf, posinf=np.inf), np.nan_to_num(at_middle - spread, nan=-np.inf, neginf=-np.inf)
        upper[~np.isfinite(at_middle) | ~np.isfinite(spread)], lower[~np.isfinite(at_middle) | ~np.isfinite(spread)] = np.inf, -np.inf
        # A component beyond 64 bits meets zeros alone where the sum stays below 62.
        small_queries, small = queries.astype(np.int64), exact.astype(np.int64)

    def scores_of(i: int) -> Callable[[np.ndarray], np.ndarray]:
        if largest[i] < 2.0**62:
            return lambda some: small[some] @ small_queries[i]
        own = [(j, int(x)) for j, x in enumerate(queries[i].tolist()) if x]
        return lambda some: np.array([sum(int(row[j]) * x for j, x in own) for row in exact[some].tolist()], object)

    found = [_search(scores_of(i), uids, int(query_uids[i]), upper[i], lower[i], ids, k) for i in range(len(queries))]
    scores = [s for _, own in found for s in own.tolist()]
    return np.repeat(np.arange(len(queries)), [len(p) for p, _ in found]), np.concatenate([p for p, _ in found]), scores


def _cells(values: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The cell of each component, of ``CELLS`` equal ones between its least and greatest value."""
    span = most / 2 - least / 2
    place = np.divide(values / 2 - least / 2, span, out=np.zeros_like(values), where=span > 0) * CELLS
    return np.clip(np.floor(place), 0, CELLS - 1).astype(np.uint8)


def _sortable(score: int) -> tuple[int, int, bytes]:
    """(beyond 64 bits: -1, 0 or 1; the score; else its bytes), in the order of scores."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, score, b""
    size = (abs(score).bit_length() + 7) // 8
    data = size.to_bytes(8, "big") + abs(score).to_bytes(size, "big")
    return (1, 0, data) if score > 0 else (-1, 0, bytes(255 - x for x in data))


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, the id, score) of the k best other rows for each row where ``is_query`` holds."""
    spark = df.sparkSession
    batch_rows(spark, 2 * BLOCK)
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)  # noqa: E731  beyond, doubles are whole
    usable = (
        df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_column).cast("array<double>").alias("v"))
        .where(F.size("v") > 0)
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf"))))
        .withColumns({"uid": F.monotonically_increasing_id(), "v": F.transform("v", whole), "dims": F.size("v")})
    )
    rows = written(usable, "vectors")

    def task_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each length the least and greatest components of a task's vectors."""
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                values = batch.filter(pa.array(dims == d)).column("v").flatten().to_numpy().reshape(-1, d)
                low, high = found.get(d, (values[0], values[0]))
                found[d] = np.minimum(low, values.min(0)), np.maximum(high, values.max(0))
        if found:
            yield pa.record_batch([pa.array(list(found), pa.int32()), *(pa.array([x[i].tolist() for x in found.values()], pa.list_(pa.float64())) for i in (0, 1))], ["dims", "least", "most"])

    def ranges_of(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:  # a row for each task
            for least, most in zip(batch.column("least").to_pylist(), batch.column("most").to_pylist(), strict=True):
                low, high = (np.array(least), np.array(most)) if low is None else (np.minimum(low, least), np.maximum(high, most))
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([low.tolist()]), pa.array([high.tolist()])], ["dims", "least", "most"])

    ranged = "dims int, least array<double>, most array<double>"
    ranges = rows.select("dims", "v").mapInArrow(task_ranges, ranged).groupBy("dims").applyInArrow(ranges_of, ranged)
    ranges = written(ranges, "ranges")
    total = rows.count()
    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK)))

    def pack(source: DataFrame, size: int, name: str) -> DataFrame:
        """Rows of one length in blocks of about ``size``."""
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dims").to_numpy()
                for d in np.unique(dims):
                    own = batch.filter(pa.array(dims == d))
                    for at in range(0, own.num_rows, size):
                        part = own.slice(at, size)
                        uids = part.column("uid").to_numpy()
                        ids = part.column("id")
                        values = np.array(part.column("v").flatten().to_numpy(), "<f8")
                        first = int(uids[0])
                        yield pa.record_batch(
                            [
                                pa.array([int(d)], pa.int32()),
                                pa.array([first]),
                                pa.array([uids.astype("<i8").tobytes()]),
                                pa.array([ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype("<i8").tobytes()]),
                                pa.array([values.tobytes()]),
                            ],
                            names=["dims", "block", "uids", "ids", "vectors"],
                        )

        return written(source.mapInArrow(run, PACKED), name, **ROW_GROUPS)

    def approximate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for vectors, least, most in zip(batch.column("vectors"), batch.column("least"), batch.column("most"), strict=True):
                least, most = (np.array(x.as_py(), np.float64) for x in (least, most))
                values = np.frombuffer(vectors.as_buffer(), "<f8").reshape(-1, len(least))
                cells.append(_cells(values, least, most).tobytes())
            yield batch.append_column("cells", pa.array(cells, pa.binary()))

    with_cells = f"{PACKED}, least array<double>, most array<double>, cells binary"
    packed, asked = pack(rows, BLOCK, "packed"), pack(rows.where("asks"), QUERIES, "queries")
    batch_rows(spark, BLOCK_ROWS)
    # A row for each length of vectors: a shuffle by it would bring all blocks of a length to one task.
    blocks = written(packed.join(F.broadcast(ranges), "dims").mapInArrow(approximate, with_cells), "blocks", **ROW_GROUPS).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # Spark sizes the queries by their files, before each group has them, and would send all that by way of the driver.
    pairs = blocks.join(asked.select("dims", "group", F.col("uids").alias("q_uids"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).hint("merge"), ["dims", "group"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row] for n in batch.schema.names}
                dims = one["dims"].as_py()
                binary = lambda n, kind, one=one: np.frombuffer(one[n].as_buffer(), kind)
                exact = binary("vectors", "<f8").reshape(-1, dims)
                least, most = (np.array(one[n].as_py(), np.float64) for n in ("least", "most"))
                cells = binary("cells", np.uint8).reshape(-1, dims)
                uids, ids = binary("uids", "<i8"), binary("ids", "<i8")
                q_uids, q_ids = binary("q_uids", "<i8"), binary("q_ids", "<i8")
                which, place, score = search_block(binary("q_vectors", "<f8").reshape(-1, dims), q_uids, exact, cells, least, most, uids, ids, k)
                order = list(zip(*map(_sortable, score), strict=True)) or [(), (), ()]
                sorted_by = {n: pa.array(x, t) for n, x, t in zip(("over", "score", "key"), order, (pa.int32(), pa.int64(), pa.binary()), strict=True)}
                yield pa.record_batch({"q_uid": q_uids[which], "query_id": q_ids[which], "uid": uids[place], "id": ids[place], **sorted_by})

    near = pairs.mapInArrow(compare, "q_uid long, query_id long, uid long, id long, over int, score long, key binary")
    best = Window.partitionBy("q_uid").orderBy(F.col("over").desc(), F.col("score").desc(), F.col("key").desc(), "id", "uid")
    ranked = written(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")
    batch_rows(spark, 2 * BLOCK)
    none = F.lit(np.iinfo(np.int64).max)
    too_large = F.raise_error(F.lit("a score that is among the best does not fit 64 bits")).cast("long")
    return ranked.select("query_id", "rank", F.when(F.col("id") != none, F.col("id")).alias(id_column), F.when(F.col("over") == 0, F.col("score")).otherwise(too_large).alias("score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
