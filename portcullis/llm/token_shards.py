"""Training-order materialisation of token ids.

``materialise`` encodes every text, cuts the ids into sequences and numbers each by its row and its
place there: 63 bits mixed from all 64 of the row's hash and the part. A keyed Feistel permutation of all
numbers (walking its cycle while a value falls outside) puts each sequence somewhere in [0, ``NUMBERS``).
Equal ranges of that are the shards: a shard gets about as many sequences as any other, sorted by place,
as records of equal length: a 4-byte little-endian token count, then the ids as 16-bit (or, for large
vocabularies, 32-bit) integers, padded with zeros. A sequence's global slot is its shard's first slot
(the sizes of the shards before) and its place there: the permuted order without the gaps. ``read`` goes
through the records from any slot on.

Texts are encoded once and ids shuffled once. Spark sorts (and spills) the records, tasks write them as
they come, so no shard is held in memory; first slots are summed by buckets of ``BUCKET`` shards, and only
a row for each bucket comes to the driver. The order depends on the key and the rows (id and text), not on
how these are dealt to files or tasks; of equal places, id, part and ids decide. A shard's file is whole or
absent and the same whichever task writes it, so lost tasks may run again. Null and empty texts make no
sequence. Rows equal in id and text make one sequence each, with one place: they stand side by side in
one shard, however many they are. Null ids are ids like others. Of the rows, only ids go to the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portcullis.llm.common import fresh_path, map_texts, texts_of, written
from portcullis.llm.sentencepiece_codec import loaded, model_bytes
from portcullis.llm.shared_files import Writer, mapped, packed, put, unpacked

LENGTH, PER_SHARD, ROUNDS, KEY = 512, 32768, 6, 20240131
#: Sequence numbers are below this.
NUMBERS = 2**63 - 25
#: Shards whose first slots are summed together.
BUCKET = 4096
#: Shards that a task writes, about: the tasks grow with the shards.
SHARDS = 4
#: Bytes of text for a token, about: it sets the number of shards, nothing else.
BYTES_PER_TOKEN = 2.5


def _mix(value: np.ndarray, key: int) -> np.ndarray:
    value = (value + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ value >> np.uint64(29)


def slots_of(index: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """The slots of the numbers: a permutation of [0, total)."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little") for r in range(ROUNDS)]
    value = index.astype(np.uint64).copy()
    walking = np.arange(len(value))
    while len(walking):
        left, right = value[walking] >> np.uint64(half), value[walking] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        value[walking] = left << np.uint64(half) | right
        walking = walking[value[walking] >= np.uint64(total)]
    return value.astype(np.int64)


def materialise(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, length: int = LENGTH, key: int = KEY, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards of about ``per_shard`` sequences under ``path`` (one of its own in the shared folder by default).

    Returns the index: for each sequence the row's id, ``part`` (its number in the row), ``slot``,
    ``shard``, ``byte_offset``, ``n_tokens`` and the SHA-256 of its ids in the file.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "token-shards")
    data = model_bytes(model_path)
    wide = len(loaded(data).pieces) > 1 << 16
    kind, width = ("<u4", 4) if wide else ("<u2", 2)
    stride = 4 + length * width
    id_type = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    size, number = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    shards = max(1, round((size / BYTES_PER_TOKEN / length + number / 2) / per_shard))
    share = -(-NUMBERS // shards)
    rows = rows.withColumn("row", F.xxhash64("id", "text"))

    def cut(batch: pa.RecordBatch, model) -> dict:
        which, parts, tokens, ids = [], [], [], []
        texts = texts_of(batch, "text")
        for i, own in enumerate(model.ids(texts)):
            if not texts[i]:
                continue
            own = np.concatenate([own, [model.eos_id]]).astype(kind)
            for part, at in enumerate(range(0, len(own), length)):
                which.append(i)
                parts.append(part)
                ids.append(own[at : at + length].tobytes())
                tokens.append(min(length, len(own) - at))
        row = batch.column("row").to_numpy()[which].view(np.uint64)
        numbers = _mix(row ^ _mix(np.array(parts, np.uint64), 1), 2) % np.uint64(NUMBERS)
        places = slots_of(numbers, NUMBERS, key) if which else []
        return {"id": batch.column("id").take(pa.array(which, pa.int64())), "part": parts, "place": places, "n_tokens": tokens, "ids": ids}

    cut_up = map_texts(rows, "text", f"id {id_type}, part int, place long, n_tokens int, ids binary", cut, lambda: loaded(data))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS))
    dealt = cut_up.withColumn("shard", F.expr(f"place div {share}")).repartition(tasks, "shard").sortWithinPartitions("shard", "place", "id", "part", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file, next_at = None, None, 0
        try:
            for batch in batches:
                own = batch.column("shard").to_numpy()
                at = np.empty(len(own), np.int64)
                digests = []
                for i, (s, n, ids) in enumerate(zip(own.tolist(), batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                    if s != shard:
                        if file:
                            file, done = None, file
                            done.close()
                        shard, file, next_at = s, Writer(f"{path}/shard-{s:012d}"), 0
                    file.write(n.to_bytes(4, "little") + ids.ljust(stride - 4, b"\0"))
                    digests.append(hashlib.sha256(ids).digest())
                    at[i] = next_at
                    next_at += 1
                made = [batch.column(c) for c in ("id", "part", "shard", "n_tokens")]
                yield pa.record_batch([*made, pa.array(at), pa.array(digests, pa.binary())], ["id", "part", "shard", "n_tokens", "at", "digest"])
            if file:
                file, done = None, file
                done.close()
        except BaseException:
            if file:
                file.drop()
            raise

    index = written(dealt.mapInArrow(write, f"id {id_type}, part int, shard long, n_tokens int, at long, digest binary"), "index")
    firsts = _first_slots(index, path)
    buckets = firsts.groupBy("bucket").agg(F.min("first").alias("first")).orderBy("bucket").collect()
    total = index.count()
    facts = {"total": total, "length": length, "stride": stride, "kind": kind, "key": key}
    put(f"{path}/manifest", packed({c: np.array([r[c] for r in buckets], np.int64) for c in ("bucket", "first")}, **facts))
    return index.join(firsts.select("shard", "first"), "shard").select(
        F.col("id").alias(id_column),
        "part",
        (F.col("first") + F.col("at")).alias("slot"),
        "shard",
        (F.col("at") * stride).alias("byte_offset"),
        "n_tokens",
        F.lower(F.hex("digest")).alias("ids_sha256"),
    )


def _first_slots(index: DataFrame, path: str) -> DataFrame:
    """(shard, bucket, first) of each shard, and a file of them for each bucket: sums of buckets, then
    running sums within each."""
    sizes = index.groupBy("shard").agg(F.count("*").alias("n")).withColumn("bucket", F.expr(f"shard div {BUCKET}"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    starts = sizes.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    def save(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        n = table.column("n").to_numpy()
        table = table.select(["shard", "bucket"]).append_column("first", pa.array(table.column("start").to_numpy() + np.cumsum(n) - n))
        put(f"{path}/slots-{table.column('bucket')[0].as_py():08d}", packed({c: table.column(c).to_numpy() for c in ("shard", "first")}))
        return table

    return written(sizes.join(starts, "bucket").groupBy("bucket").applyInArrow(save, "shard long, bucket long, first long"), "slots")


def read(path: str, slot: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) in training order, from ``slot`` on."""
    arrays, facts = unpacked(mapped(f"{path}/manifest"))
    width = np.dtype(facts["kind"]).itemsize
    for b in range(max(0, int(np.searchsorted(arrays["first"], slot, "right")) - 1), len(arrays["first"])):
        own, _ = unpacked(mapped(f"{path}/slots-{arrays['bucket'][b]:08d}"))
        for s in range(max(0, int(np.searchsorted(own["first"], slot, "right")) - 1), len(own["first"])):
            records = mapped(f"{path}/shard-{own['shard'][s]:012d}").reshape(-1, facts["stride"])
            for record in records[slot - int(own["first"][s]) :]:
                n = int(record[:4].view("<u4")[0])
                yield slot, np.array(record[4 : 4 + n * width].view(facts["kind"]))
                slot += 1
