"""Suffix-array dedup over a sparse suffix array of word positions.

Only suffixes at content-selected positions are kept: the start of the 8-word
gram with the smallest hash among SPAN neighbouring grams (a minimiser), so two
copies of a passage select the same positions inside it.

1. The hash of a suffix's first PREFIX words finds the prefixes that occur more
   than once.  Every run of LEAST words has such a position among its first
   SPAN words, and PREFIX more words inside it.
2. Suffixes with such a prefix carry SPAN words of context on either side.
   They are sorted by prefix and by each way to extend it to LEAST words (k to
   the left, SPAN - k to the right), and neighbours are compared.  Comparing
   at every extension is what no third suffix can hide: two copies of LEAST
   words are neighbours, or have only copies between them, at one of them.
3. The first occurrence of such a run in the order of (doc_id, text hash,
   position) stays; the words of all others are removed from their texts.  An
   occurrence that overlaps the first one in the same text loses only the words
   beyond it.
So exactly the runs of LEAST words that occur more than once are found, and
longer passages as runs that overlap.

A prefix with HOT_LEAST or more suffixes among those that a map task sends off
at once is hot.  Its suffixes are dealt over all bins in step 1; in step 2 each
extension goes to a bin of its own, after a map task has resolved all but the
first occurrence that it sees itself.

Defined results
  empty table          no rows
  null text            stays null, counts 0
  empty or short text  unchanged
  very long text       whole
  null doc_id          ordered after all others
  rows with equal id and text   one document: each gets the same result
  ties                 the earlier position stays
  extra columns        passed through; n_words, n_removed (in any case) are replaced
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, STEP, U64, Words, binary_column, chunks, discard, materialise, mix, multipliers, sieve, window_hashes, with_cuts

GRAM, SPAN, LEAST = 8, 16, 50
PREFIX = LEAST - SPAN
FLUSH = 400_000
HOT_LEAST = 64
BIN_BYTES = 30_000_000
TOP = np.iinfo(np.uint64).max
RECORD = np.dtype([("h", "<u8"), ("right", "<u4", SPAN), ("left", "<u4", SPAN), ("id", "<i8"), ("tk", "<i8"), ("at", "<u4")])


def suffixes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the first PREFIX words, text, word index) at the selected positions."""
    codes, owner = words.codes, words.owner()
    none = np.empty(0, np.int64)
    g = window_hashes(codes, GRAM)
    if g.size < SPAN:
        return none.astype(U64), none, none
    g[owner[: g.size] != owner[GRAM - 1 :]] = TOP
    low = np.lib.stride_tricks.sliding_window_view(g, SPAN)
    at = np.unique(low.argmin(axis=1) + np.arange(low.shape[0]))
    at = at[(g[at] != TOP) & (at + PREFIX <= codes.size)]
    at = at[owner[at] == owner[at + PREFIX - 1]]
    h = np.zeros(at.size, U64)
    for j, m in enumerate(multipliers(PREFIX, 5)):
        h += codes[at + j] * m
    return mix(h), owner[at], at


def by_bin(to: np.ndarray, columns: list[np.ndarray]):
    """(bin, columns) of each bin in ``to``."""
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), to.size).tolist() if to.size else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(to[a]), [c[a:b] for c in columns]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bin", "blob"])


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where the equal entries of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if x.size else np.empty(0, np.int64)


def seed_bins(docs: DataFrame, bins: int) -> DataFrame:
    """(bin, blob) of all selected suffixes.

    A blob: the numbers of its suffixes, of hot ones that were dealt here and
    of marks (hot prefixes whose own bin this is); then their columns.
    """
    hot_least = HOT_LEAST

    def pack(h, ids, tks, at):
        order = np.argsort(h, kind="stable")
        h, ids, tks, at = (x[order] for x in (h, ids, tks, at))
        starts = runs_of(h)
        count = np.diff(np.append(starts, h.size))
        hot = np.repeat(count >= hot_least, count)
        marks = h[starts[count >= hot_least]]
        spread = mix(h + mix(ids.view(U64) + mix(tks.view(U64) + at.astype(U64))))
        parts: dict[int, list] = {}
        for kind, (on, key) in enumerate(((~hot, h), (hot, spread))):
            for b, cols in by_bin((key[on] % U64(bins)).astype(np.int64), [h[on], ids[on], tks[on], at[on].astype(np.uint32)]):
                parts.setdefault(b, [(0, b"")] * 3)[kind] = (cols[0].size, b"".join(c.tobytes() for c in cols))
        for b, (cols,) in by_bin((marks % U64(bins)).astype(np.int64), [marks]):
            parts.setdefault(b, [(0, b"")] * 3)[2] = (cols.size, cols.tobytes())
        for b, three in parts.items():
            yield b, np.array([n for n, _ in three], np.int64).tobytes() + b"".join(x for _, x in three)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = np.array([LAST if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            tks = batch.column("tk").to_numpy(zero_copy_only=False)
            for base, texts in chunks(binary_column(batch, "text")):
                words = Words(texts)
                h, owner, at = suffixes(words)
                held.append((h, ids[base + owner], tks[base + owner], at - words.first[owner]))
                size += h.size
                if size >= FLUSH:
                    yield batch_of(list(pack(*(np.concatenate(x) for x in zip(*held)))))
                    held, size = [], 0
        yield batch_of(list(pack(*(np.concatenate(x) for x in zip(*held)))) if size else [])

    return docs.mapInArrow(run, "bin int, blob binary")


def repeated_seeds(table: pa.Table) -> pa.Table:
    """The suffixes of a bin whose prefix occurs more than once; ``at``: twice the position, plus one if hot.

    One row a suffix: rows for each document would grow with the number of bins
    over which its suffixes lie, and so faster than the table.
    """
    parts, marks = [], []
    for blob in table.column("blob").to_pylist():
        n, m, k = np.frombuffer(blob, np.int64, 3).tolist()
        o = 24
        for size, hot in ((n, False), (m, True)):
            cols = [np.frombuffer(blob, t, size, o + w * size) for t, w in ((U64, 0), (np.int64, 8), (np.int64, 16), (np.uint32, 24))]
            parts.append((*cols, np.full(size, hot)))
            o += 28 * size
        marks.append(np.frombuffer(blob, U64, k, o))
    h, ids, tks, at, hot = (np.concatenate(x) for x in zip(*parts))
    hot |= np.isin(h, np.concatenate(marks))
    order = np.lexsort((at, tks, ids, h))
    h, ids, tks, at, hot = (x[order] for x in (h, ids, tks, at, hot))
    new = np.ones(h.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]) | (tks[1:] != tks[:-1]) | (at[1:] != at[:-1])
    h, ids, tks, at, hot = (x[new] for x in (h, ids, tks, at, hot))
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    keep = (count[back] > 1) | hot
    order = np.lexsort((at[keep], tks[keep], ids[keep]))
    ids, tks, at, hot = (x[keep][order] for x in (ids, tks, at, hot))
    return pa.table({"doc_id": ids, "tk": tks, "at": 2 * at.astype(np.int64) + hot})


def extensions(rec: np.ndarray) -> np.ndarray:
    """For each suffix and k from 0 to SPAN, a hash of the run with k words to the left; zero where the text ends before."""
    n = rec.size
    m = multipliers(2 * SPAN, 31)
    out = np.empty((n, SPAN + 1), U64)
    right, left = np.zeros((n, SPAN + 1), U64), np.zeros((n, SPAN + 1), U64)
    for side, words, first in ((right, rec["right"], 0), (left, rec["left"], SPAN)):
        for j in range(SPAN):
            side[:, j + 1] = side[:, j] + mix(words[:, j].astype(U64) + STEP) * m[first + j]
    for k in range(SPAN + 1):
        out[:, k] = mix(rec["h"] + mix(left[:, k] + STEP * U64(k)) + right[:, SPAN - k])
        whole = (rec["left"][:, k - 1] != 0 if k else True) & (rec["right"][:, SPAN - k - 1] != 0 if k < SPAN else True)
        out[~np.broadcast_to(whole, n), k] = 0
    return out


def ordered(rec: np.ndarray) -> np.ndarray:
    """In the order of (id, tk, at), without repeated entries: rows equal in id and text are one document."""
    rec = rec[np.lexsort((rec["at"], rec["tk"], rec["id"]))]
    new = np.ones(rec.size, bool)
    new[1:] = (rec["at"][1:] != rec["at"][:-1]) | (rec["tk"][1:] != rec["tk"][:-1]) | (rec["id"][1:] != rec["id"][:-1])
    return rec[new]


def first_of(keys: np.ndarray) -> np.ndarray:
    """For each entry the index of the first entry of its key; entries are in order."""
    order = np.argsort(keys, kind="stable")
    starts = runs_of(keys[order])
    out = np.empty(keys.size, np.int64)
    out[order] = np.repeat(order[starts], np.diff(np.append(starts, keys.size)))
    return out


def removals(ids, tks, at, first) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the words that go from each run that begins at ``at``; first: index of the one that stays."""
    near = (ids == ids[first]) & (tks == tks[first])
    return np.where(near, np.maximum(at, at[first] + LEAST), at), at + LEAST


SPANS = "doc_id long, tk long, a long, b long"


def span_table(ids, tks, a, b) -> pa.Table:
    """Spans, those that touch or overlap in one document joined."""
    order = np.lexsort((a, tks, ids))
    ids, tks, a, b = (np.asarray(x)[order].astype(np.int64) for x in (ids, tks, a, b))
    if not a.size:
        return pa.table({"doc_id": ids, "tk": tks, "a": a, "b": b})
    doc = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tks[1:] != tks[:-1])])
    lift = np.cumsum(doc) * (int(b.max()) + 1)  # so that documents do not meet
    reach = np.maximum.accumulate(b + lift)
    new = np.concatenate([[True], (a + lift)[1:] > reach[:-1]])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], a.size) - 1
    return pa.table({"doc_id": ids[starts], "tk": tks[starts], "a": a[starts], "b": reach[ends] - lift[ends]})


#: one extension of a hot suffix: the run's hash and where it begins; done: not its first occurrence
POINT = np.dtype([("key", "<u8"), ("id", "<i8"), ("tk", "<i8"), ("at", "<u4"), ("done", "u1")])


def context_bins(joined: DataFrame, bins: int) -> DataFrame:
    """(bin, blob) of repeated suffixes with SPAN words on either side.

    Codes have 32 bits; zero stands for no word.  Bins from ``bins`` on hold
    the extensions of hot suffixes.
    """

    def points(rec: np.ndarray):
        rec = ordered(rec)
        keys = extensions(rec)
        own, k = np.nonzero(keys)
        point = np.zeros(own.size, POINT)
        point["key"], point["id"], point["tk"], point["at"] = keys[own, k], rec["id"][own], rec["tk"][own], rec["at"][own] - k
        point = point[np.lexsort((point["at"], point["tk"], point["id"]))]
        first = first_of(point["key"])
        later = first != np.arange(first.size)
        ids, tks, at = point["id"], point["tk"], point["at"].astype(np.int64)
        a, b = removals(ids, tks, at, first)
        gone = span_table(ids[later], tks[later], a[later], b[later])
        done = np.zeros(gone.num_rows, POINT)  # key holds a span's end
        for name, col in (("id", "doc_id"), ("tk", "tk"), ("at", "a"), ("key", "b")):
            done[name] = gone.column(col).to_numpy()
        done["done"] = 1
        point = point[~later]
        every = np.concatenate([point, done])
        to = mix(np.where(every["done"] == 1, every["tk"].view(U64) + every["key"], every["key"]))
        for b, (cols,) in by_bin((to % U64(bins)).astype(np.int64), [every]):
            yield b + bins, cols.tobytes()

    def run(batches):
        for batch in batches:
            ids, tks, lists = batch.column("doc_id").to_pylist(), batch.column("tk").to_pylist(), batch.column("ats").to_pylist()
            rows, hots = [], []
            for base, texts in chunks(binary_column(batch, "text")):
                words = Words(texts)
                codes = words.codes
                short = np.concatenate([(codes >> U64(32)).astype(np.uint32) | np.uint32(1), [np.uint32(0)]])
                for i in range(len(texts)):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    both = np.unique(np.array(lists[base + i], np.int64))
                    at = (both >> 1) + a
                    h = np.zeros(at.size, U64)
                    for j, m in enumerate(multipliers(PREFIX, 5)):
                        h += codes[at + j] * m
                    left = at[:, None] - 1 - np.arange(SPAN)
                    right = at[:, None] + PREFIX + np.arange(SPAN)
                    rec = np.zeros(at.size, RECORD)
                    rec["h"], rec["id"], rec["tk"], rec["at"] = mix(h), LAST if ids[base + i] is None else ids[base + i], tks[base + i], at - a
                    rec["left"] = short[np.where(left >= a, left, -1)]
                    rec["right"] = short[np.where(right < b, right, -1)]
                    rows.append(rec[both & 1 == 0])
                    hots.append(rec[both & 1 == 1])
            out = []
            if rows:
                rec = np.concatenate(rows)
                out += [(b, cols.tobytes()) for b, (cols,) in by_bin((rec["h"] % U64(bins)).astype(np.int64), [rec])]
                out += points(np.concatenate(hots))
            yield batch_of(out)

    return joined.mapInArrow(run, "bin int, blob binary")


def extend(table: pa.Table, bins: int) -> pa.Table:
    """Sort a bin's suffixes at every extension and compare neighbours: word spans to remove."""
    blob = b"".join(table.column("blob").to_pylist())
    if table.column("bin")[0].as_py() >= bins:
        point = np.frombuffer(blob, POINT)
        done = point[point["done"] == 1]
        point = ordered_points(point[point["done"] == 0])
        ids, tks, at = point["id"], point["tk"], point["at"].astype(np.int64)
        first = first_of(point["key"])
        on = first != np.arange(first.size)
        a, b = removals(ids, tks, at, first)
        parts = [(ids[on], tks[on], a[on], b[on]), (done["id"], done["tk"], done["at"].astype(np.int64), done["key"].astype(np.int64))]
    else:
        rec = ordered(np.frombuffer(blob, RECORD))
        keys, ids, tks = extensions(rec), rec["id"], rec["tk"]
        parts = []
        for k in range(SPAN + 1):
            at, key = rec["at"].astype(np.int64) - k, keys[:, k]
            first = first_of(key)
            on = (first != np.arange(first.size)) & (key != 0)
            a, b = removals(ids, tks, at, first)
            parts.append((ids[on], tks[on], a[on], b[on]))
    return span_table(*(np.concatenate(x) for x in zip(*parts)))


def ordered_points(point: np.ndarray) -> np.ndarray:
    point = point[np.lexsort((point["key"], point["at"], point["tk"], point["id"]))]
    new = np.ones(point.size, bool)
    new[1:] = np.logical_or.reduce([point[c][1:] != point[c][:-1] for c in ("id", "tk", "at", "key")])
    return point[new]


def cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The text without the words in spans (a to b, end exclusive); its words; those removed."""
    words = Words([text])
    n = words.starts.size
    if not spans or not n:
        return text, n, 0
    gone = np.zeros(n, bool)
    for s in spans:
        gone[s["a"] : s["b"]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    starts = np.append(words.starts, len(text)).tolist()
    out, at = [], 0
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        out.append(text[at : starts[a]])
        at = starts[b]
    out.append(text[at:])
    left = b"".join(out)
    return (left if not gone.all() else b""), n, int(gone.sum())


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages removed from text, plus n_words and n_removed."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BIN_BYTES))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("tk"), "text").where("text IS NOT NULL")
    found = seed_bins(keyed, bins).groupBy("bin").applyInArrow(repeated_seeds, "doc_id long, tk long, at long")
    seeds = materialise(found.groupBy("doc_id", "tk").agg(F.collect_list("at").alias("ats")))
    joined = sieve(keyed, seeds, "doc_id", "tk").join(seeds, ["doc_id", "tk"]).select("doc_id", "tk", "text", "ats")
    cuts = context_bins(joined, bins).groupBy("bin").applyInArrow(lambda t: extend(t, bins), SPANS)
    spans = materialise(cuts.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("a", "b")).alias("spans")).select(F.col("doc_id").alias("s_id"), F.col("tk").alias("s_tk"), "spans"))
    discard(seeds)
    return with_cuts(docs, spans, cut, ["n_words", "n_removed"])
