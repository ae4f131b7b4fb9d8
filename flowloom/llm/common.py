"""Shared helpers: stable word hashes, materialised tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Where none is set, a local master gets a temporary one (tests); a cluster raises.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="flowloom-")
        sc.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: it cuts the
    lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables; all that reads them must have been written itself."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(conf).delete(path, True)


def result_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` other than ``names``, in Spark's sense (case does not count)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def own_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around)."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x = x ^ (x >> U64(27))
    x = x * MIX_B
    return x ^ (x >> U64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def window_hashes(codes: np.ndarray, width: int, seed: int = 17) -> np.ndarray:
    """Hashes of all runs of ``width`` codes."""
    n = codes.size - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for j, m in enumerate(multipliers(width, seed)):
        out += codes[j : j + n] * m
    return mix(out)


SOLID = np.ones(256, bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
STEP = U64(0x9E3779B97F4A7C15)
LONG_WORD = 4096


def chunks(texts: list, limit: int = 4_000_000):
    """Split a list of bytes (None: empty) into runs of about ``limit`` bytes: (offset, run)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield at, [x or b"" for x in texts[at : i + 1]]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, [x or b"" for x in texts[at:]]


class Words:
    """The words (runs of bytes other than ASCII white space) of some texts.

    codes: a stable 64-bit hash of each word; starts, ends: bytes in ``joined``;
    first: index of each text's first word, with one more entry at the end;
    begin: byte at which each text starts.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.lower()
        self.joined = joined
        buf = np.frombuffer(joined, np.uint8)
        solid = SOLID[buf]
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if solid[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, self.begin)
        self.codes = self._codes()

    def _codes(self) -> np.ndarray:
        padded = self.joined + bytes(8)
        load = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, strides=(1,))
        size = self.ends - self.starts
        h = mix((load[self.starts] & MASKS[np.minimum(size, 8)]) + size.astype(U64) * STEP)
        rest, off = np.flatnonzero(size > 8), 8
        while rest.size:
            if off >= LONG_WORD:
                for i in rest:
                    h[i] = xxhash.xxh3_64_intdigest(self.joined[self.starts[i] : self.ends[i]])
                break
            h[rest] = mix(h[rest] * STEP + (load[self.starts[rest] + off] & MASKS[np.minimum(size[rest] - off, 8)]))
            off += 8
            rest = rest[size[rest] > off]
        return h

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(self.first.size - 1), np.diff(self.first))


def binary_column(batch, name: str) -> list:
    """A string column of an Arrow batch as bytes (None for null)."""
    import pyarrow as pa

    return batch.column(name).cast(pa.binary()).to_pylist()


#: 64-bit words of a sieve: its most rows
SIEVE_WORDS = 1 << 18


def flagged(df: DataFrame, wanted: DataFrame, key: list[str], flag: str, words: int | None = None) -> DataFrame:
    """``df`` plus a column: false where the row's key is surely not in ``wanted`` (whose first columns are the key).

    A bitmap of hashed keys, at most ``words`` rows however many are wanted, is
    broadcast.  It never misses a wanted row; a fuller bitmap flags more of the
    other rows too.
    """
    words = words or SIEVE_WORDS
    word, bits, spot = (own_name(df, n) for n in ("word", "bits", "spot"))

    def bit(c):
        return F.expr(f"shiftleft(1L, cast(`{c}` % 64 AS int))")

    hashed = wanted.select(F.pmod(F.xxhash64(*wanted.columns[: len(key)]), F.lit(64 * words)).alias(spot))
    table = hashed.groupBy(F.shiftright(spot, 6).alias(word)).agg(F.bit_or(bit(spot)).alias(bits))
    placed = df.withColumn(spot, F.pmod(F.xxhash64(*key), F.lit(64 * words))).withColumn(word, F.shiftright(spot, 6))
    hit = F.coalesce(F.col(bits).bitwiseAND(bit(spot)) != 0, F.lit(False))
    return placed.join(F.broadcast(table), word, "left").withColumn(flag, hit).drop(spot, word, bits)


def sieve(df: DataFrame, wanted: DataFrame, *key: str, words: int | None = None) -> DataFrame:
    """The rows of ``df`` whose key may be among those of ``wanted``, for the exact join that follows."""
    flag = own_name(df, "flag")
    return flagged(df, wanted.select(*key), list(key), flag, words).where(flag).drop(flag)


LAST = np.iinfo(np.int64).max


def with_cuts(docs: DataFrame, spans: DataFrame, cut, counts: list[str]) -> DataFrame:
    """``docs`` with text cut by the spans of its (doc_id, text hash), plus two counts.

    spans: a written table (s_id, s_tk, spans), a null id as LAST; cut(text,
    spans) gives the new text and the counts.  Null texts stay null with counts 0.
    """
    import pyarrow as pa

    extra = result_columns(docs, counts)
    ident, tk, found = (own_name(docs, n) for n in ("ident", "tk", "found"))
    full = docs.select(*extra, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias(ident), F.xxhash64("text").alias(tk))
    flag = own_name(full, "flag")
    full = flagged(full, spans, [ident, tk], flag)
    cutting = full.where(flag).join(spans.select(F.col("s_id"), F.col("s_tk"), F.col("spans").alias(found)), (F.col(ident) == F.col("s_id")) & (F.col(tk) == F.col("s_tk")), "left").select(*extra, found)
    # texts without a span are not shuffled
    full = cutting.unionByName(full.where(~F.col(flag)).select(*extra).withColumn(found, F.lit(None).cast(spans.schema["spans"].dataType)))
    schema = T.StructType([docs.schema[c] for c in extra] + [T.StructField(c, T.LongType()) for c in counts])

    def run(batches):
        for batch in batches:
            texts, n, removed = [], [], []
            for text, some in zip(binary_column(batch, "text"), batch.column(found).to_pylist()):
                new, a, b = (None, 0, 0) if text is None else cut(text, some or [])
                texts.append(None if new is None else new.decode())
                n.append(a)
                removed.append(b)
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in extra]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[*extra, *counts])

    return full.mapInArrow(run, schema)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge list -> (node, root), root the smallest node.

    Alternating large-star and small-star rounds.  A round takes the least
    neighbour of each node with a partially aggregated minimum and joins it
    back, so no neighbour list is ever gathered; with_totals deals the edges of
    heavy nodes over several join keys.  Null ends
    and loops are ignored; nodes without an edge are absent.  Rounds grow with
    the logarithm of the diameter; each is written, the one before deleted.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    e = materialise(e)
    before, state = None, edge_state(e)
    while state != before:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * state[0], "v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = with_least(down, 2 * state[0])
        new = materialise(
            joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        )
        discard(e)
        e, before, state = new, state, edge_state(new)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


HEAVY, SALTS = 500, 64
#: rows of two numbers that one task may well hold
FEW = 1_000_000


def edge_state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def with_least(e: DataFrame, most: int, only: str = "true") -> DataFrame:
    """(u, v, m): the edges where ``only`` holds, with the least neighbour m of u.

    most: a bound of the number of edges.
    """
    return with_totals(e, "u", "v", most, F.min("v").alias("m"), only=only)


def with_totals(df: DataFrame, key: str, by: str, most: int, *totals: Column, only: str = "true") -> DataFrame:
    """The rows of ``df`` where ``only`` holds, with totals over all rows of their key.

    most: a bound of the number of rows.  Above FEW rows, a key with more than
    one in HEAVY of them is joined over SALTS keys, dealt by column ``by``; at
    most HEAVY keys are heavy, and the broadcast list of them has that many
    rows.  Up to FEW rows the largest group fits any task as it is.
    """
    if most <= FEW:
        return df.where(only).join(df.groupBy(key).agg(*totals), key)
    low = df.groupBy(key).agg(*totals, F.count("*").alias("__c"))
    few = F.col("__c") <= F.lit(max(1, most // HEAVY))
    spread = low.withColumn("__s", F.explode(F.when(few, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1))))).drop("__c")
    heavy = low.where(~few).select(key, F.lit(SALTS).alias("__n"))
    dealt = df.where(only).join(F.broadcast(heavy), key, "left").withColumn("__s", F.pmod(F.xxhash64(by), F.coalesce("__n", F.lit(1))).cast("int"))
    return dealt.join(spread, [key, "__s"]).drop("__s", "__n")
