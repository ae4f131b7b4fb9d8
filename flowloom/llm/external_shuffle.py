"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly over buckets of about BUCKET_BYTES by a
seeded hash; pass 2 loads one bucket at a time, puts it into a Fisher-Yates
order and writes it.  A row's place is its bucket's offset plus its place
there; place mod shards is the shard, so shard sizes differ by one row at most
(law ``rows``), and place div shards is its slot.

Equal rows are told apart by their count within an input partition, so a row
repeated often spreads over buckets too.  The sizes of the buckets are read
from what pass 2 wrote, so they fit it even where a task ran twice.  The
offsets (one number for each bucket, that is for every BUCKET_BYTES of data)
pass through the driver.

Defined results
  empty table          no rows
  null or empty text   size 1
  very long text       whole; a bucket holds it beside its other rows
  null doc_id          hashed like a value
  ties                 equal rows are interchangeable
  repeated rows        each has a place of its own
  extra columns        passed through; shard and slot (in any case) are replaced
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, materialise, mix, own_name, result_columns

BUCKET_BYTES = 64_000_000


def scatter(df: DataFrame, buckets: int, seed: int, bucket: str, order: str) -> DataFrame:
    """``df`` plus two columns of the given names: the bucket and a seeded 64-bit hash."""
    hashed = df.withColumn(order, F.xxhash64(F.lit(seed), *df.columns))
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(bucket, T.IntegerType()), T.StructField(order, T.LongType())])

    def run(batches):
        times: dict[int, int] = {}
        for batch in batches:
            rows = batch.column(order).to_pylist()
            nth = np.empty(len(rows), U64)
            for i, r in enumerate(rows):
                nth[i] = times[r] = times.get(r, -1) + 1
            h = mix(mix(np.array(rows, np.int64).view(U64)) + nth)
            to = ((h >> U64(32)) * U64(buckets)) >> U64(32)
            cols = [batch.column(c) for c in names] + [pa.array(to.astype(np.int32)), pa.array(h.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, bucket, order])

    return hashed.mapInArrow(run, schema)


def shuffle(df: DataFrame, shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` plus shard and slot, from the buckets that pass 2 wrote into the shared folder."""
    spark = df.sparkSession
    df = df.select(result_columns(df, ["shard", "slot"]))
    width = F.octet_length("text") if "text" in df.columns else F.lit(100)
    total = df.agg(F.sum(F.coalesce(width, F.lit(0)) + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bucket_bytes))
    names, bucket, place = df.columns, own_name(df, "bucket"), own_name(df, "place")

    def permute(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column(place).to_numpy(), kind="stable"))
        table = table.take(np.random.default_rng([seed, table.column(bucket)[0].as_py()]).permutation(table.num_rows))
        return table.select([*names, bucket]).append_column(place, pa.array(np.arange(table.num_rows)))

    dealt = scatter(df, buckets, seed, bucket, place)
    written = materialise(dealt.groupBy(bucket).applyInArrow(permute, T.StructType(dealt.schema.fields)))
    sizes = np.zeros(buckets, np.int64)
    for b, n in written.groupBy(bucket).count().toLocalIterator():
        sizes[b] = n
    offset = own_name(df, "offset")
    offsets = spark.createDataFrame([(b, o) for b, o in enumerate((np.cumsum(sizes) - sizes).tolist()) if sizes[b]], f"`{bucket}` int, `{offset}` long")
    at = F.col(offset) + F.col(place)
    # one row for every BUCKET_BYTES of data
    return written.join(F.broadcast(offsets), bucket).select(*names, (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write one folder per shard; ``slot`` gives the order in it."""
    shuffled.write.partitionBy("shard").parquet(path)


def digest(shuffled: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    return shuffled.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
