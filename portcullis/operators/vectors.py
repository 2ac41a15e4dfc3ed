"""Similarity to labelled examples.

Scores are matrix products over blocks: a task multiplies a batch of texts' vectors with all examples and
keeps each text's best. The examples are a configured corpus of some hundreds, which goes to every task
within a checked size (``MOST`` rows, ``MOST_BYTES``). A larger one is cut into blocks that meet the
queries by a grid, and the best of all blocks are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MOST, MOST_BYTES = 50_000, 64 << 20
#: Beyond it: examples of a block and queries of a bucket; numbers of a matrix of scores that are held at once.
BLOCK, BUCKET, CELLS = 10_000, 20_000, 1 << 18
LABELS = ("attack", "benign")


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of this width without nulls, their vectors)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    whole = ~np.isnan(flat).any(1)
    return rows[whole], flat[whole]


def _numbered(values: pa.ChunkedArray) -> tuple[np.ndarray, dict]:
    """Values as numbers, the same for equal ones, and the number of each."""
    number: dict = {}
    return np.array([number.setdefault(x, len(number)) for x in values.to_pylist()], np.int64), number


class Examples:
    """Examples in the order of their ids, so that the first of equal scores has the smallest."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("example")
        lengths = pc.max(pc.list_value_length(table["example_vector"])).as_py() if table.num_rows else None
        self.width = lengths or 0
        kept, self.vectors = _matrix(table["example_vector"], self.width) if self.width else (np.zeros(0, np.int64), np.zeros((0, 0)))
        table = table.take(pa.array(kept))
        self.ids, labels = table["example"].combine_chunks(), np.array(table["label"].to_pylist(), object)
        self.own = {label: np.flatnonzero(labels == label) for label in LABELS}
        self.names, self.name_of = _numbered(table["example"])
        if "group" in table.column_names:
            self.groups, self.group_of = _numbered(table["group"])

    def best(self, batch: pa.RecordBatch | pa.Table, k: int, leave_out: bool) -> tuple[dict, dict]:
        """For each label: number of a query's best (k at most), their scores and places, all queries behind one another."""
        found = {label: (np.zeros(batch.num_rows, np.int64), [], []) for label in LABELS}
        rows, vectors = _matrix(batch.column("vector"), self.width) if self.width else (np.zeros(0, np.int64), None)
        if leave_out:
            queries = np.array([self.name_of.get(q, -1) for q in batch.column("query").to_pylist()], np.int64)
            groups = np.array([-1 if g is None else self.group_of.get(g, -1) for g in batch.column("query_group").to_pylist()], np.int64)
        step = max(1, CELLS // max(1, len(self.names)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            # Scores count to six places: whole numbers, which a place makes different from one another.
            scores = np.rint(vectors[at : at + step] @ self.vectors.T * 1e6).astype(np.int64)
            for label, own in self.own.items():
                mine = scores[:, own]
                key = mine * len(own) + np.arange(len(own))[::-1] if len(own) else mine
                counts = np.full(len(some), min(k, len(own)))
                if leave_out:
                    group = groups[some, None]
                    out = (self.names[own] == queries[some, None]) | ((self.groups[own] == group) & (group >= 0))
                    key = np.where(out, -(1 << 62), key)
                    counts = np.minimum(k, (~out).sum(1))
                top = np.argsort(-key, 1, kind="stable")[:, :k] if len(own) <= 4 * k else _largest(key, k)
                taken = np.arange(top.shape[1]) < counts[:, None]
                number, score, place = found[label]
                number[some] = counts
                score.append(np.take_along_axis(mine, top, 1)[taken] / 1e6)
                place.append(own[top[taken]])
        return found


def _largest(key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, in falling order."""
    top = np.argpartition(key, key.shape[1] - k, 1)[:, -k:]
    order = np.argsort(-np.take_along_axis(key, top, 1), 1)
    return np.take_along_axis(top, order, 1)


def _lists(found: tuple, ids: pa.Array) -> pa.Array:
    number, score, place = found
    score, place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((score, np.float64), (place, np.int64)))
    entries = pa.StructArray.from_arrays([pa.array(-score), ids.take(pa.array(place.astype(np.int64)))], ["order", "example"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32()), entries)


def margins(queries: DataFrame, examples: DataFrame, k: int = 3, leave_out: bool = False) -> DataFrame:
    """(query, attack, benign, margin, nearest): mean of the k best scores with each label, and the id of
    the best attack. ``queries`` has query, vector; ``examples`` has example, label (attack, benign) and
    example_vector. With ``leave_out`` a query doesn't meet the example of its own id nor those of its group
    (query_group, group). Queries without a vector of the examples' width have no scores.
    """
    asked = queries.select("query", "vector", *(["query_group"] if leave_out else []))
    known = examples.select("example", "label", "example_vector", *(["group"] if leave_out else []))
    kind, example = queries.schema["query"].dataType, examples.schema["example"].dataType
    schema = f"query {kind.simpleString()}, " + ", ".join(f"{c} array<struct<order:double,example:{example.simpleString()}>>" for c in "ab")

    def made(batch: pa.RecordBatch | pa.Table, of: Examples) -> pa.RecordBatch:
        found = of.best(batch, k, leave_out)
        query = batch.column("query")
        return pa.record_batch([query.combine_chunks() if isinstance(query, pa.ChunkedArray) else query, *[_lists(found[x], of.ids.cast(to_arrow_type(example))) for x in LABELS]], ["query", "a", "b"])

    held = known.limit(MOST + 1).toArrow()  # bounded by MOST rows; larger ones aren't used
    if held.num_rows <= MOST and held.nbytes <= MOST_BYTES:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = Examples(held)
            for batch in batches:
                yield made(batch, of)

        top = asked.mapInArrow(run, schema)
    else:
        blocks, buckets = -(-examples.count() // BLOCK), -(-queries.count() // BUCKET)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n) - 1).cast("long")))
        of_bucket = asked.withColumn("__bucket", F.pmod(F.xxhash64("query", "vector"), F.lit(max(1, buckets)))).withColumn("__block", every(blocks))
        of_block = known.withColumn("__block", F.pmod(F.xxhash64("example", "example_vector"), F.lit(blocks))).withColumn("__bucket", every(buckets))
        of_bucket, of_block = (x.groupBy("__bucket", "__block") for x in (of_bucket, of_block))
        some = of_bucket.cogroup(of_block).applyInArrow(lambda mine, theirs: pa.Table.from_batches([made(mine, Examples(theirs))]), schema)
        merged = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, k).alias(c)
        top = some.groupBy("query").agg(merged("a"), merged("b"))
    mean = lambda c: F.round(F.try_divide(-F.aggregate(c, F.lit(0.0), lambda s, x: s + x["order"]), F.size(c)), 6)
    means = top.select("query", mean(F.col("a")).alias("attack"), mean(F.col("b")).alias("benign"), F.try_element_at("a", F.lit(1))["example"].alias("nearest"))
    return means.withColumn("margin", F.round(F.col("attack") - F.col("benign"), 6))


def verdict(scored: DataFrame, block: float, margin: float, grey: float, grey_margin: float) -> DataFrame:
    """Block over both thresholds, grey (risk 0.5) over both lower ones, else clean."""
    over = lambda s, m: (F.col("attack") >= s) & (F.col("margin") >= m)
    return scored.withColumn("verdict", F.when(over(block, margin), "block").when(over(grey, grey_margin), "grey").otherwise("clean"))


# The grid of thresholds.
SIMS, GAPS = [x / 100 for x in range(40, 96)], [x / 100 for x in range(41)]


def hits(scored: DataFrame, sims: list[float], gaps: list[float]) -> DataFrame:
    """(i, j, sim, gap, attacks, benigns, all_attacks, all_benigns): how many points of each label reach both
    thresholds. ``scored`` has label, attack, margin; points without scores count in the whole alone.

    A point lies in one cell of a two-dimensional histogram, of as many cells as thresholds, whatever the
    number of points; what reaches a pair of thresholds is the sum of the cells beyond it.
    """
    reached = lambda value, steps: F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: F.coalesce(value >= t, F.lit(False)))) - 1
    cells = scored.groupBy(reached(F.col("attack"), sims).alias("i"), reached(F.col("margin"), gaps).alias("j")).agg(*[F.count(F.when(F.col("label") == x, 1)).alias(x) for x in LABELS])
    axis = lambda name, steps: F.explode(F.array(*[F.struct(F.lit(n).alias(name), F.lit(t).alias("at")) for n, t in enumerate(steps)]))
    grid = scored.sparkSession.range(1).select(axis("i", sims).alias("x")).select("x", axis("j", gaps).alias("y")).select("x.i", "y.j", F.col("x.at").alias("sim"), F.col("y.at").alias("gap"))
    along = lambda by, of: Window.partitionBy(by).orderBy(F.col(of).desc())  # noqa: E731  a row or column of the grid
    own = grid.join(cells, ["i", "j"], "left").select("i", "j", "sim", "gap", *[F.coalesce(x, F.lit(0)).alias(x) for x in LABELS])
    rows = own.withColumns({x: F.sum(x).over(along("i", "j")) for x in LABELS})
    sums = rows.withColumns({x: F.sum(x).over(along("j", "i")) for x in LABELS})
    whole = scored.agg(*[F.count(F.when(F.col("label") == x, 1)).alias(f"all_{x}s") for x in LABELS])
    return sums.join(F.broadcast(whole)).withColumnsRenamed({x: f"{x}s" for x in LABELS})  # one row beside the grid


def calibrate(scored: DataFrame, block_rate: float = 0.01, escalation: float = 0.1, sims: list[float] | None = None, gaps: list[float] | None = None) -> DataFrame:
    """One row of thresholds: to block, the best recall among those whose share of benign points is at most
    ``block_rate``; to ask a judge, the best recall of both together within ``escalation``, at a similarity no
    higher. Of equal recalls the higher thresholds win. Without any, the highest thresholds block and nothing more
    is asked about.

    Both follow from one table of sums: a point reaches either pair of thresholds as often as each alone, less both.
    """
    sims, gaps = sims or SIMS, gaps or GAPS
    table = hits(scored, sims, gaps).select("*", (F.col("attacks") / F.col("all_attacks")).alias("recall"), (F.col("benigns") / F.col("all_benigns")).alias("rate"))
    order = lambda recall: F.struct(F.col(recall), (F.col("sim") + F.col("gap")).alias("sum"), F.col("sim"), F.col("gap"))
    first = table.agg(F.max_by(F.struct("i", "j", "sim", "gap", "recall", "rate", "attacks", "benigns"), F.when(F.col("rate") <= block_rate, order("recall"))).alias("b"))
    highest = table.where((F.col("i") == len(sims) - 1) & (F.col("j") == len(gaps) - 1)).select(F.struct("i", "j", "sim", "gap", "recall", "rate", "attacks", "benigns").alias("h"))
    fallen = first.join(highest).select(F.coalesce("b", "h").alias("b"))
    # Points beyond both pairs: beyond the block's similarity and the larger of the two margins.
    both = table.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("attacks").alias("both_attacks"), F.col("benigns").alias("both_benigns"))
    pairs = table.join(F.broadcast(fallen)).where(F.col("i") <= F.col("b.i"))
    met = pairs.join(both, (F.col("bi") == F.col("b.i")) & (F.col("bj") == F.greatest(F.col("j"), F.col("b.j"))))
    share = lambda x: (F.col(f"b.{x}s") + F.col(f"{x}s") - F.col(f"both_{x}s")) / F.col(f"all_{x}s")
    shares = met.select("b", "sim", "gap", share("attack").alias("total"), share("benign").alias("asked"))
    second = shares.groupBy("b").agg(F.max_by(F.struct("sim", "gap", "total", "asked"), F.when(F.col("asked") <= escalation, order("total"))).alias("g"))
    grey = F.coalesce("g", F.struct(F.col("b.sim"), F.col("b.gap"), F.col("b.recall").alias("total"), F.col("b.rate").alias("asked")))
    return second.select("b", grey.alias("g")).select(
        F.col("b.sim").alias("sim_block"), F.col("b.gap").alias("margin_block"), F.col("g.sim").alias("sim_grey"), F.col("g.gap").alias("margin_grey"),
        *[F.round(c, 6).alias(name) for c, name in (("b.recall", "block_recall"), ("b.rate", "block_rate"), ("g.total", "total_recall"), ("g.asked", "escalation"))],
    )
