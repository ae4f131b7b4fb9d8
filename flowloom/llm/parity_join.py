"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles; two documents link when
100 * |A n B| >= 75 * |A u B|, that is when 7 * |A ^ B| <= |A| + |B|.

1. Equal sets become one node (a 64-bit fingerprint of the set).
2. Every node XORs its shingle hashes into a sketch of p segments, p fixed per
   size band.  One shingle can change one segment only, so the number of
   differing segments (a Hamming distance) never exceeds |A ^ B|.  With
   p > d segments that hold a shingle, where d is the largest difference a
   linked pair of the band may have, a linked pair agrees on a segment
   (pigeonhole).
3. A node with s spare segments may leave out its s commonest ones, by one
   global order of segment frequency: the rarest agreeing segment of a linked
   pair is among those that both keep.  This removes segments made of shared
   passages alone, and loses no link.
4. Nodes that share a kept segment form clusters.  Inside a cluster pairs are
   tested: first the Hamming distance of 2048-bit parity sketches, a lower
   bound of the difference, then the exact sets.  A pair that is already in
   one component needs no test.  A large cluster is cut into blocks of bounded
   bytes.  Each block first meets the cluster's hub (its smallest node); then
   only members outside the hub's component meet the other blocks.

A segment key is sent with a 39-bit number of its node: a node that shares the
number with another gets the other's keys too, which adds candidates and drops
none.  Nodes of a key that is frequent within one map task (HOT) are dealt over
all bins by node; the key's own bin receives their number, not the nodes.

Defined results
  empty table                   no rows
  null or empty text, no word   n_shingles 0, component_id = doc_id
  fewer than five words         the whole word sequence is the one shingle
  very long text                whole; its set is held by one task at a time
  null doc_id                   kept as a row; smallest non-null id of the component
  repeated rows                 each row is returned
  ties                          component_id is the smallest doc_id
  extra columns                 ignored; ``keep_one`` passes them through
Hashes have 64 bits: two shingles of a document collide with a chance of about
n^2 / 2^65.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, U64, Words, binary_column, chunks, components, discard, materialise, mix, multipliers, own_name, sieve, window_hashes, with_least, with_totals

SHINGLE = 5
#: keys that a map task gathers before it sends them off, and keys per bin of the key join
FLUSH, KEYS_PER_BIN = 1_000_000, 1_500_000
#: nodes of one key among the keys sent off at once that make the key hot there
HOT = 256
#: nodes and shingles of a block
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
BITS = 2048


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    h = window_hashes(words.codes, SHINGLE)
    short = multipliers(SHINGLE, 99)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(h[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((words.codes[a:b] * short[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(np.empty(0, U64))
    return out


def fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set of hashes."""
    return int(mix(mix(s ^ STEP).sum(keepdims=True) + U64(s.size)).view(np.int64)[0])


@functools.lru_cache(maxsize=None)
def band_start(k: int) -> int:
    return 1 if k == 0 else max(band_start(k - 1) + 1, math.ceil(band_start(k - 1) * 16 / 9))


def bands(n: int) -> list[tuple[int, int, int]]:
    """(band, segments, largest difference of a linked pair handled there) of a set of n shingles.

    A pair is handled in the band of its smaller set, so a set also joins the
    band below when a partner of three quarters its size may lie there.
    """
    k = 0
    while band_start(k + 1) <= n:
        k += 1

    def segments(k: int) -> int:
        top = band_start(k + 1) - 1
        return max(64, math.ceil(1.2 * ((top + 4 * top // 3) // 7 + 1)) + 8)

    out = [(k, segments(k), (n + 4 * n // 3) // 7)]
    if k and 4 * (band_start(k) - 1) >= 3 * n:
        out.append((k - 1, segments(k - 1), (n + band_start(k) - 1) // 7))
    return out


def segments_of(s: np.ndarray, p: int) -> np.ndarray:
    """The segment of each hash of a sorted set."""
    return ((s >> U64(32)) * U64(p)) >> U64(32)


def spare_segments(s: np.ndarray, p: int, d: int) -> int:
    """How many of its commonest segments a set may leave out."""
    at = segments_of(s, p)
    return max(0, 1 + int((at[1:] != at[:-1]).sum()) - d - 1)


def segment_keys(s: np.ndarray, band: int, p: int, d: int) -> np.ndarray:
    """Keys (48 bits) of the sketch's segments.

    Empty segments are keys only of the rare sets that fill d segments or less.
    """
    at = segments_of(s, p)
    starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    segment, where = np.bitwise_xor.reduceat(mix(s ^ U64(0x5851F42D4C957F2D)), starts), at[starts]
    if starts.size <= d:
        empty = np.setdiff1d(np.arange(p, dtype=U64), where)
        where, segment = np.concatenate([where, empty]), np.concatenate([segment, np.zeros(empty.size, U64)])
    return mix(segment + mix(where + U64(band << 40))) >> U64(16)


def node_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, n_shingles, node, spare, spare_low) of every document; tk is a hash of the text.

    spare and spare_low: segments that the set may leave out in its own band and in the one below.
    """
    names = ["doc_id", "tk", "n_shingles", "node", "spare", "spare_low"]

    def run(batches):
        for batch in batches:
            n, node, spare = [], [], []
            for _, texts in chunks(binary_column(batch, "text")):
                for s in shingle_sets(texts):
                    n.append(s.size)
                    node.append(fingerprint(s) if s.size else None)
                    spare.append([spare_segments(s, p, d) for _, p, d in bands(s.size)] if s.size else [])
            cols = [pa.array(n, pa.int64()), pa.array(node, pa.int64())] + [pa.array([x[k] if len(x) > k else None for x in spare], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), *cols], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def low_bytes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_bytes(blob: bytes, count: int, at: int, n: int) -> np.ndarray:
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :n] = np.frombuffer(blob, np.uint8, n * count, at).reshape(-1, n)
    return wide.view("<u8").ravel().astype(U64)


def key_bits(total: int) -> int:
    """Bits of a key (48 at most): 18 more than number ``total`` keys, so chance seldom makes two equal."""
    return min(48, total.bit_length() + 18)


def key_width(bins: int, bits: int) -> int:
    """Bytes of a key's quotient by ``bins``."""
    return (((1 << bits) // bins).bit_length() + 7) // 8


def key_bins(docs: DataFrame, bins: int, bits: int) -> DataFrame:
    """(bin, blob): the segment keys of all nodes, packed per map task and bin.

    A blob holds keys of its bin with their nodes, members of hot keys dealt
    here, and the counts of its own hot keys' members elsewhere.  A node is its
    39-bit number, doubled, plus 1 in the band below its own.
    """
    width, hot_least, cut = key_width(bins, bits), HOT, U64(48 - bits)

    def pack(refs, keys):
        key, ref = np.concatenate(keys) >> cut, np.repeat(np.array(refs, U64), [k.size for k in keys])
        order = np.argsort(key, kind="stable")
        key, ref = key[order], ref[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(starts, key.size))
        hot = np.repeat(count >= hot_least, count)
        marks, times = key[starts][count >= hot_least], count[count >= hot_least]
        groups = ((key[~hot], ref[~hot], key[~hot]), (key[hot], ref[hot], mix(key[hot] + ref[hot] * STEP)), (marks, times, marks))
        parts: dict[int, list] = {}
        for kind, (k, v, to) in enumerate(groups):
            to = (to % U64(bins)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            k, v, to = k[order], v[order], to[order]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if to.size else [], to.size).astype(int).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                one = low_bytes(k[a:b] // U64(bins), width) if kind != 1 else low_bytes(k[a:b], 6)
                parts.setdefault(int(to[a]), [(0, b"")] * 3)[kind] = (b - a, one + low_bytes(v[a:b], 5))
        for b, three in parts.items():
            yield b, np.array([n for n, _ in three], np.int64).tobytes() + b"".join(x for _, x in three)

    def run(batches):
        refs, keys, held, seen = [], [], 0, set()

        def flush():
            rows = list(pack(refs, keys)) if keys else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bin", "blob"])

        for batch in batches:
            for _, texts in chunks(binary_column(batch, "text")):
                for s in shingle_sets(texts):
                    node = fingerprint(s) if s.size else None
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    number = (node & ((1 << 64) - 1)) >> 25
                    for low, (k, p, d) in enumerate(bands(s.size)):
                        refs.append(2 * number + low)
                        keys.append(segment_keys(s, k, p, d))
                        held += keys[-1].size
                if held >= FLUSH:
                    yield flush()
                    refs, keys, held, seen = [], [], 0, set()
        yield flush()

    return docs.select("text").mapInArrow(run, "bin int, blob binary")


def once(key: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ref, key))
    key, ref = key[order], ref[order]
    new = np.ones(key.size, bool)
    new[1:] = (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])
    return key[new], ref[new]


def shared_keys(table: pa.Table, bins: int, bits: int) -> pa.Table:
    """(ref, key, cnt) of the keys of a bin that two or more nodes have.

    cnt is null for members of hot keys of other bins; ref is null in the rows
    that give the whole count of a hot key.
    """
    width, here = key_width(bins, bits), U64(table.column("bin")[0].as_py())
    plain, hot, marks = [], [], []
    for blob in table.column("blob").to_pylist():
        at = 24
        for into, n, w in zip((plain, hot, marks), np.frombuffer(blob, np.int64, 3).tolist(), (width, 6, width)):
            k, v = from_bytes(blob, n, at, w), from_bytes(blob, n, at + w * n, 5)
            into.append((k if into is hot else k * U64(bins) + here, v))
            at += (w + 5) * n
    key, ref = (np.concatenate(x) for x in zip(*plain))
    mark, times = (np.concatenate(x) for x in zip(*marks))
    marked_keys, where = np.unique(mark, return_inverse=True)
    more = np.bincount(where, times.astype(np.int64), marked_keys.size).astype(np.int64)
    ranked = np.sort(key)
    twice = np.union1d(ranked[1:][ranked[1:] == ranked[:-1]], marked_keys)
    on = np.isin(key, twice)
    key, ref = once(key[on], ref[on])
    names, back, cnt = np.unique(key, return_inverse=True, return_counts=True)
    if marked_keys.size and names.size:
        at = np.minimum(np.searchsorted(marked_keys, names), marked_keys.size - 1)
        cnt = cnt + np.where(marked_keys[at] == names, more[at], 0)
    own = np.zeros(marked_keys.size, np.int64)
    if names.size:
        at = np.minimum(np.searchsorted(names, marked_keys), names.size - 1)
        own = np.where(names[at] == marked_keys, cnt[at], 0)
    cnt = cnt[back]
    key, ref, cnt = key[cnt > 1], ref[cnt > 1], cnt[cnt > 1]
    far, far_ref = once(*(np.concatenate(x) for x in zip(*hot)))
    none = lambda n: pa.nulls(n, pa.int64())
    col = lambda x: pa.array(x.astype(np.int64))
    return pa.table(
        {
            "ref": pa.concat_arrays([col(ref), col(far_ref), none(marked_keys.size)]),
            "key": pa.concat_arrays([col(key), col(far), col(marked_keys)]),
            "cnt": pa.concat_arrays([col(cnt), none(far.size), col(np.maximum(own, more))]),
        }
    )


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 7 * (a.size + b.size - 2 * common) <= a.size + b.size


def forest(nodes: np.ndarray, sets: list[np.ndarray], label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the links among these sets connect.

    label: sets of equal label are connected already.
    """
    label = np.arange(len(sets)) if label is None else label
    size = np.array([s.size for s in sets])
    sketch = np.zeros((len(sets), BITS // 8), np.uint8)
    for i, s in enumerate(sets):
        sketch[i] = np.packbits((np.bincount((s & U64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(bool))
    sketch = sketch.view(np.uint64)
    out, rest = [], np.arange(len(sets))
    while rest.size:
        same = label[rest] == label[rest[0]]
        frontier, rest = rest[same].tolist(), rest[~same]
        while frontier and rest.size:
            x = frontier.pop()
            near = np.flatnonzero((4 * np.minimum(size[rest], size[x]) >= 3 * np.maximum(size[rest], size[x])))
            apart = np.bitwise_count(sketch[rest[near]] ^ sketch[x]).sum(axis=1)
            near = near[7 * apart.astype(np.int64) <= size[rest[near]] + size[x]]
            hit = [int(rest[i]) for i in near.tolist() if linked(sets[x], sets[rest[i]])]
            if hit:
                out += [(int(nodes[x]), int(nodes[i])) for i in hit]
                joined = np.isin(label[rest], label[hit])
                frontier += rest[joined].tolist()
                rest = rest[~joined]
    return out


def member_sets(docs: DataFrame, cand: DataFrame) -> DataFrame:
    """cand (node, root, blocks, comp, doc_id, tk) with the members' shingle sets."""
    names = ["node", "root", "blocks", "comp"]

    def run(batches):
        for batch in batches:
            want = batch.column("node").to_pylist()
            for at, texts in chunks(binary_column(batch, "text")):
                out, keep = [], []
                for i, s in enumerate(shingle_sets(texts)):
                    if s.size and fingerprint(s) == want[at + i]:
                        out.append(s.tobytes())
                        keep.append(at + i)
                cols = [batch.column(c).take(pa.array(keep, pa.int64())) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], names=[*names, "shingles"])

    c = cand.select(*names, F.col("doc_id").alias("c_id"), F.col("tk").alias("c_tk"))
    full = sieve(docs, cand, "doc_id", "tk").join(c, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tk") == F.col("c_tk"))).select(*names, "text")
    return full.mapInArrow(run, "node long, root long, blocks int, comp long, shingles binary")


def resolve(table: pa.Table) -> pa.Table:
    """Links inside each (root, i, j) of a group; members of one comp are connected already."""
    groups: dict[tuple, dict] = {}
    for root, i, j, node, comp, s in zip(*(table.column(c).to_pylist() for c in ("root", "i", "j", "node", "comp", "shingles"))):
        groups.setdefault((root, i, j), {})[node] = (node if comp is None else comp, s)
    links = []
    for g in groups.values():
        names = np.array(sorted(g), np.int64)
        links += forest(names, [np.frombuffer(g[x][1], U64) for x in names.tolist()], np.array([g[x][0] for x in names.tolist()], np.int64))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def block_of(blocks: str) -> F.Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def cluster_links(docs: DataFrame, cand: DataFrame, bins: int) -> DataFrame:
    """Links inside small clusters and inside the blocks of large ones, whose hub meets every block.

    The hub is copied once for each block of its cluster, other members not at all.
    """
    own = block_of("blocks")
    place = F.when((F.col("blocks") > 1) & (F.col("node") == F.col("root")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    dealt = member_sets(docs, cand).withColumn("i", F.explode(place)).withColumn("j", F.lit(-1))
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root", "i"))
    return dealt.select(group.alias("g"), "root", "i", "j", "node", "comp", "shingles").groupBy("g").applyInArrow(resolve, "a long, b long")


def cross_links(docs: DataFrame, cand: DataFrame) -> DataFrame:
    """Links between the blocks of large clusters that touch an open member.

    cand: (node, root, blocks, comp, open, open_blocks, doc_id, tk).  Open
    members, those outside their hub's component, meet every block; the others
    are copied once for each block of open ones.
    """
    flags = cand.select("node", "open", "open_blocks")
    rows = member_sets(docs, cand).join(flags, "node")
    names = ["root", "node", "comp", "shingles"]
    every = rows.withColumn("i", block_of("blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("open_blocks") - 1)))
    some = rows.where("open").withColumn("j", block_of("open_blocks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = every.select("i", "j", *names).unionByName(some.select("i", "j", *names))
    return dealt.withColumn("g", F.xxhash64("root", "i", "j")).groupBy("g").applyInArrow(resolve, "a long, b long")


def resolved(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, tk, n_shingles, first) of every row of ``docs`` (doc_id, text), and whether rows repeat.

    first: (no_id, doc_id, tk), the first document of the row's component in
    the order of doc_id (null last) and text hash; null without a word.
    """
    spark = docs.sparkSession
    rows = materialise(node_rows(docs))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    repeated = not rows.groupBy("doc_id", "tk").count().where("count > 1").isEmpty()
    place = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "tk")
    if not total:
        return rows.select("doc_id", "tk", "n_shingles", F.when(F.col("n_shingles") > 0, place).alias("first")), repeated
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bins = max(2 * least, math.ceil(0.75 * total / KEYS_PER_BIN))
    nodes = materialise(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.min(place).alias("at"), F.first("n_shingles").alias("n"), F.first("spare").alias("spare"), F.first("spare_low").alias("spare_low"))
    )
    bits = key_bits(total)
    shared = materialise(key_bins(docs, bins, bits).groupBy("bin").applyInArrow(lambda t: shared_keys(t, bins, bits), "ref long, key long, cnt long"))
    # members of hot keys get the key's count over 16 salted joins
    salts = F.explode(F.sequence(F.lit(0), F.lit(15)))
    hot = shared.where("ref IS NULL").select("key", "cnt", salts.alias("s"))
    far = shared.where("cnt IS NULL").select("ref", "key", F.pmod("ref", F.lit(16)).cast("int").alias("s")).join(hot, ["key", "s"]).select("ref", "key", "cnt")
    member = shared.where("ref IS NOT NULL AND cnt IS NOT NULL").unionByName(far).groupBy("ref").agg(F.sort_array(F.collect_set(F.struct("cnt", "key"))).alias("keys"))
    numbered = nodes.select("node", F.shiftrightunsigned("node", 25).alias("number"), "spare", "spare_low")
    spare = F.when(F.col("ref") % 2 == 1, F.col("spare_low")).otherwise(F.col("spare"))
    kept = materialise(
        member.withColumn("number", F.shiftright("ref", 1))
        .join(numbered, "number")
        .withColumn("left_out", spare)
        .where("size(keys) > left_out")
        .select("node", F.explode(F.expr("slice(keys, 1, cast(size(keys) - left_out AS int))")).alias("k"))
        .select(F.col("k.key").alias("u"), F.col("node").alias("v"))
    )
    clusters = components(with_least(kept, kept.count()).select("v", "m"), "v", "m")
    sized = clusters.join(nodes.select("node", "n", "at.doc_id", "at.tk"), "node")
    sized = with_totals(sized, "root", "node", nodes.count(), F.count("*").alias("size"), F.sum("n").alias("weight"))
    large = (F.col("size") > 2 * BLOCK) | (F.col("weight") > 2 * BLOCK_SHINGLES)
    blocks = F.when(large, F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES))).otherwise(1).cast("int")
    cand = materialise(sized.select("node", "root", "size", "n", blocks.alias("blocks"), F.lit(None).cast("long").alias("comp"), "doc_id", "tk"))
    discard(shared, kept)
    count, weight = cand.agg(F.count("*"), F.sum("n")).first()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    if repeated:
        text = text.dropDuplicates(["doc_id", "tk"])
    links = materialise(cluster_links(text, cand, max(1, count // BLOCK, (weight or 0) // BLOCK_SHINGLES)))
    found = components(links, "a", "b")
    many = cand.where("blocks > 1")
    if not many.isEmpty():
        links2 = open_links(text, many, found, count)
        if links2 is not None:
            found = components(links.unionByName(links2), "a", "b")
    named = found.join(nodes.select("node", "at"), "node")
    lowest = materialise(with_totals(named, "root", "node", count, F.min("at").alias("lowest")).select("node", "lowest"))
    to = materialise(nodes.join(lowest, "node", "left").select("node", F.coalesce("lowest", "at").alias("first")))
    discard(cand, links, lowest, nodes)
    return rows.join(to, "node", "left").select("doc_id", "tk", "n_shingles", "first"), repeated


def open_links(text: DataFrame, many: DataFrame, found: DataFrame, count: int) -> DataFrame | None:
    """The links across the blocks of large clusters, if any member is open."""
    comp = F.coalesce("found_root", "node")
    named = many.drop("comp").join(found.select("node", F.col("root").alias("found_root")), "node", "left").withColumn("comp", comp)
    hubs = named.where("node = root").select("root", F.col("comp").alias("hub_comp"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(15)))
    told = named.withColumn("s", F.pmod("node", F.lit(16)).cast("int")).join(hubs.withColumn("s", salts), ["root", "s"])
    told = materialise(told.withColumn("open", F.col("comp") != F.col("hub_comp")).drop("s", "hub_comp", "found_root"))
    opened = told.where("open").groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("open_blocks"))
    if opened.isEmpty():
        discard(told)
        return None
    work = materialise(told.withColumn("s", F.pmod("node", F.lit(16)).cast("int")).join(opened.withColumn("s", salts), ["root", "s"]).drop("s"))
    out = materialise(cross_links(text, work))
    discard(told, work)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    found, _ = resolved(docs)
    return found.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the first by doc_id (null last) and text hash.

    Documents are told apart by id and text, so an id that stands on two texts
    loses only the one that links to another document.  Of rows that repeat an
    id and text one stays.  Documents without a word link with nothing: all
    their rows stay.  All columns are passed through.
    """
    found, repeated = resolved(docs.select("doc_id", "text"))
    mine = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "tk")
    gone = found.where(F.col("first").isNotNull() & (F.col("first") != mine)).select(F.col("doc_id").alias("g_id"), F.col("tk").alias("g_tk")).distinct()
    ident, tk = own_name(docs, "ident"), own_name(docs, "tk")
    keyed = docs.withColumn(ident, F.col("doc_id").cast("long")).withColumn(tk, F.xxhash64("text"))
    one = keyed.join(gone, F.col(ident).eqNullSafe(F.col("g_id")) & (F.col(tk) == F.col("g_tk")), "left_anti")
    if not repeated:
        return one.select(docs.columns)
    again = found.where("first IS NOT NULL").groupBy(F.col("doc_id").alias("a_id"), F.col("tk").alias("a_tk")).count().where("count > 1").select("a_id", "a_tk")
    again = materialise(again)
    same = F.col(ident).eqNullSafe(F.col("a_id")) & (F.col(tk) == F.col("a_tk"))
    twice = one.join(again, same, "left_semi").dropDuplicates([ident, tk])
    return one.join(again, same, "left_anti").unionByName(twice).select(docs.columns)
