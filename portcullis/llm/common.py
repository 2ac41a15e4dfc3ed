"""What the operators share: the shared folder, cut lineage, batches, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.llm.shared_files import mapped, put

#: Bytes of text that a task works on at a time, and rows of texts that go to Python together.
PORTION_BYTES, TEXT_ROWS = 4 << 20, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="portcullis-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one step in the shared folder: they cut lineage like ``written`` ones, and ``clear``
    deletes them once what was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(path := fresh_path(self.spark, name))
        df.write.parquet(path)
        self._collect()
        return self.spark.read.schema(df.schema).parquet(path)

    def _collect(self) -> None:
        """Spark deletes a shuffle's files when the driver's JVM collects it: now, not at some later time."""
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.paths = []
        self._collect()


def row_set(rows: DataFrame, name: str, scratch: Scratch | None = None):
    """A column function that tells whether a row is one of ``rows`` (row: numbers that
    ``monotonically_increasing_id`` gave a written table).

    The numbers of one task are a bitmap in a file of their own, which tasks map: a semi join on the
    numbers that moves none of the table's other columns.
    """
    folder, bits = fresh_path(rows.sparkSession, name), 33
    if scratch:
        scratch.paths.append(folder)

    def write(table: pa.Table) -> pa.Table:
        row = table.column("row").to_numpy()
        places = row & ((1 << bits) - 1)
        marks = np.zeros(int(places.max()) + 1, bool)
        marks[places] = True
        put(f"{folder}/{row[0] >> bits}", np.packbits(marks, bitorder="little").tobytes())
        return pa.table({"task": pa.array([row[0] >> bits], pa.int64())})

    rows.select("row", F.shiftright("row", bits).alias("task")).groupBy("task").applyInArrow(write, "task long").write.format("noop").mode("overwrite").save()

    @F.arrow_udf("boolean")
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        files: dict[int, np.ndarray] = {}
        for batch in batches:
            row = batch.to_numpy()
            found, task = np.zeros(len(row), bool), row >> bits
            for t in np.unique(task).tolist():
                if t not in files:
                    try:
                        files[t] = mapped(f"{folder}/{t}")
                    except FileNotFoundError:  # none of its rows
                        files[t] = np.zeros(0, np.uint8)
                own = np.flatnonzero(task == t)
                places = row[own] & ((1 << bits) - 1)
                inside = places < 8 * len(files[t])
                places = places[inside]
                found[own[inside]] = (files[t][places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
            yield pa.array(found)

    return held


def apart(taken: list[str], names: list[str]) -> list[str]:
    """``names``, each with underscores before it until it is none of ``taken``."""
    used, found = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found


def batch_rows(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Rows of an Arrow batch in the plans that follow: texts are long, so batches of Spark's default
    number of rows take tens of MB in the JVM and in Python each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def new_column(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_portions(batches: Iterable[pa.RecordBatch], column: str, most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text, a row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


_kept: dict[object, object] = {}
_wanted: set[object] = set()


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` makes, once in each Python worker for the tasks that ask for it one after another:
    a task of ``map_texts`` that doesn't ask drops it."""
    _wanted.add(key)
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def hand_back() -> None:
    """Give freed memory back to the system. Allocators keep it otherwise, and a Python worker that
    Spark uses for task after task holds the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)


def map_texts(df: DataFrame, column: str, schema, work: Callable[..., dict | None], prepare=None, most: int = PORTION_BYTES) -> DataFrame:
    """mapInArrow over ``df``: ``work`` turns some rows into the columns of ``schema``.

    ``prepare`` is called once in each task; what it returns goes to ``work`` as a second argument.
    ``work`` gets rows with ``most`` bytes of text, about.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    batch_rows(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _wanted.clear()
        extra = (prepare(),) if prepare else ()
        for key in _kept.keys() - _wanted:
            del _kept[key]
        for batch in text_portions(batches, column, most):
            made = work(batch, *extra)
            if made is not None:
                yield pa.record_batch([pa.array(made[f.name], f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in out], schema=out)
        batch = made = extra = None
        hand_back()

    return df.mapInArrow(run, schema)


def beside(df: DataFrame, columns: list[str], text_column: str, schema, work: Callable[..., dict | None], prepare=None, most: int = PORTION_BYTES, more: dict[str, Column] | None = None) -> DataFrame:
    """``columns`` of ``df`` and beside them the columns of ``schema`` that ``work`` makes of the texts.

    ``work`` gets batches of ``text`` and the columns ``more``; what it returns under ``rows``, if
    anything, are the places of the batch's rows that its results are for. Result columns whose names
    ``columns`` has already get underscores.
    """
    from pyspark.sql.types import StructField, StructType

    own = StructType([StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(columns)])
    results = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    made = StructType(own.fields + [StructField(f"r{i}", f.dataType) for i, f in enumerate(results)])
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{text_column}`").alias("text"), *[x.alias(n) for n, x in (more or {}).items()])

    def run(batch: pa.RecordBatch, *extra) -> dict | None:
        found = work(batch, *extra)
        if found is None:
            return None
        taken = batch.take(pa.array(found["rows"], pa.int64())) if "rows" in found else batch
        return {f"c{i}": taken.column(f"c{i}") for i in range(len(columns))} | {f"r{i}": found[f.name] for i, f in enumerate(results)}

    return map_texts(rows, "text", made, run, prepare, most).toDF(*columns, *apart(columns, results.names))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def connected(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b): nodes that links connect have one root.

    Each round, every node goes over to the neighbour (or itself) with the smallest hash, and the
    links between what is left are made distinct: in expectation a constant share of the nodes goes
    each time, whatever the shape of the graph. The rounds' choices are then followed back. All
    aggregates combine before they shuffle, so a node with very many links makes no large task, and
    each round is written to the shared folder. Null nodes have no links.
    """
    written = scratch.written if scratch else globals()["written"]
    edges = written(
        edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    chosen: list[DataFrame] = []
    left, number = edges, 0
    while not left.isEmpty():
        number += 1
        key = lambda c, n=number: F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("v"))
        ends = left.select(F.col("a").alias("node"), F.least(key("a"), key("b")).alias("best")).unionByName(
            left.select(F.col("b").alias("node"), F.least(key("a"), key("b")).alias("best"))
        )
        best = ends.groupBy("node").agg(F.min("best").alias("best"))
        over = written(best.select("node", F.col("best.v").alias("root")), "choice")
        chosen.append(over)
        for end in "ab":
            left = left.join(over.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end)
        left = written(
            left.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).where("a <> b").distinct(), "links"
        )
    if not chosen:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = chosen[-1]
    for over in reversed(chosen[:-1]):
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("later"))
        roots = written(over.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root")), "roots")
    return roots
