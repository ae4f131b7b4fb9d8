"""Substring dedup by sliding sentence spans.

A sentence ends after a word with a final ``.``, ``!`` or ``?``, at a line
break, or with the text.  The shortest run of at least two sentences with
MIN_WORDS words or more is hashed that starts at each sentence, and the one
that ends at each.  A sentence of LONE_WORDS words is also a run by itself, so
that a long passage without a full stop, which is one sentence, is found too.
These cover every longer run, to both of its ends.  Runs that occur more than
once anywhere are repeated spans; the first occurrence in the order of (doc_id, text hash,
position) stays, and the sentences that any other occurrence covers are
removed.

A map task keeps only its own first occurrence of a run and marks the others at
once, so a run that a third of all documents hold reaches the join once per
task.

Defined results
  empty table           no rows
  very long text        whole
  null text             stays null, counts 0
  empty or blank text   unchanged
  all sentences gone    empty text
  null doc_id           ordered after all others
  rows with equal id and text   one document: each gets the same result
  ties                  same document: the earlier position comes first
  extra columns         passed through; n_sentences, n_removed (in any case) are replaced
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, STEP, U64, Words, binary_column, chunks, materialise, mix, with_cuts

MIN_WORDS, LONE_WORDS = 16, 24
FLUSH = 500_000
#: bytes of text for each bin of the global join
BIN_BYTES = 30_000_000


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of each sentence's first word, and the text that it belongs to."""
    n = words.starts.size
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    buf = np.frombuffer(words.joined, np.uint8)
    breaks = np.flatnonzero(buf == 10)
    stop = np.isin(buf[words.ends - 1], np.frombuffer(b".!?", np.uint8))
    following = np.append(words.starts[1:], buf.size)
    stop |= np.searchsorted(breaks, following) > np.searchsorted(breaks, words.ends)
    first = np.concatenate([[0], np.flatnonzero(stop[:-1]) + 1])
    return first, np.searchsorted(words.first, first, side="right") - 1


def runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first sentence in its text, sentences) of every run."""
    first, owner = sentences(words)
    if not first.size:
        none = np.empty(0, np.int64)
        return none.astype(U64), none, none, none
    total = words.codes.size
    size = np.diff(np.append(first, total))
    place = np.arange(total) - np.repeat(first, size)
    h = mix(np.add.reduceat(mix(words.codes + place.astype(U64) * STEP), first))
    before = np.append(first, total)
    here = np.arange(first.size)
    last = np.maximum(np.searchsorted(before, first + MIN_WORDS) - 1, here + 1)
    head = np.minimum(np.searchsorted(first, before[1:] - MIN_WORDS, side="right") - 1, here - 1)
    lone = size >= LONE_WORDS
    # a run that is the shortest from its start and to its end counts once
    other = (head >= 0) & (last[head] != here)
    s = np.concatenate([here, head[other], here[lone]])
    last = np.concatenate([last, here[other], here[lone]])
    keep = last < first.size
    keep[keep] = owner[last[keep]] == owner[s[keep]]
    s = s[keep]
    count = last[keep] - s + 1
    out = count.astype(U64)
    for k in range(int(count.max(initial=0))):
        on = count > k
        out[on] += mix(h[s[on] + k] + U64(k + 1))
    begin = np.searchsorted(owner, owner[s])
    return mix(out), owner[s], s - begin, count


def fresh(*keys: np.ndarray) -> np.ndarray:
    """Where sorted entries differ from the one before: repeated rows give equal ones."""
    out = np.ones(keys[0].size, bool)
    if out.size:
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def scatter(docs: DataFrame, bins: int) -> DataFrame:
    """(bin, blob): for each map task and bin its first occurrences and the others."""

    def pack(h, ids, tks, at, count):
        order = np.lexsort((at, tks, ids, h))
        h, ids, tks, at, count = (x[order] for x in (h, ids, tks, at, count))
        new = fresh(h, ids, tks, at)
        h, ids, tks, at, count = (x[new] for x in (h, ids, tks, at, count))
        again = np.zeros(h.size, bool)
        again[1:] = h[1:] == h[:-1]
        to = (h % U64(bins)).astype(np.int64)
        order = np.lexsort((again, to))
        h, ids, tks, at, count, again, to = (x[order] for x in (h, ids, tks, at, count, again, to))
        cuts = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), to.size).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            ahead = int((~again[a:b]).sum())
            parts = (np.array([b - a, ahead], np.int64), h[a : a + ahead], ids[a:b], tks[a:b], at[a:b].astype(np.uint32), count[a:b].astype(np.uint32))
            yield int(to[a]), b"".join(x.tobytes() for x in parts)

    def run(batches):
        held, size = [], 0

        def flush():
            rows = list(pack(*(np.concatenate(x) for x in zip(*held)))) if held else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bin", "blob"])

        for batch in batches:
            ids = np.array([LAST if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            tks = batch.column("tk").to_numpy(zero_copy_only=False)
            for base, texts in chunks(binary_column(batch, "text")):
                h, owner, at, count = runs(Words(texts))
                held.append((h, ids[base + owner], tks[base + owner], at, count))
                size += h.size
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return docs.mapInArrow(run, "bin int, blob binary")


def repeats(table: pa.Table) -> pa.Table:
    """The non-first occurrences of a bin's runs: (doc_id, tk, at, n)."""
    heads, rest = [], []
    for blob in table.column("blob").to_pylist():
        n, ahead = (int(x) for x in np.frombuffer(blob, np.int64, 2))
        h = np.frombuffer(blob, U64, ahead, 16)
        o = 16 + 8 * ahead
        cols = [np.frombuffer(blob, np.int64, n, o), np.frombuffer(blob, np.int64, n, o + 8 * n), np.frombuffer(blob, np.uint32, n, o + 16 * n), np.frombuffer(blob, np.uint32, n, o + 20 * n)]
        heads.append((h, *(c[:ahead] for c in cols)))
        rest.append(tuple(c[ahead:] for c in cols))
    h, ids, tks, at, n = (np.concatenate(x) for x in zip(*heads))
    order = np.lexsort((at, tks, ids, h))
    h, ids, tks, at, n = (x[order] for x in (h, ids, tks, at, n))
    # rest entries lie behind the head of their own blob, so none equals the first of all
    new = fresh(h, ids, tks, at)
    h, ids, tks, at, n = (x[new] for x in (h, ids, tks, at, n))
    again = np.zeros(h.size, bool)
    again[1:] = h[1:] == h[:-1]
    more = [np.concatenate(x) for x in zip(*rest)]
    ids, tks, at, n = (np.concatenate([x[again], y]) for x, y in zip((ids, tks, at, n), more))
    return pa.table({"doc_id": ids, "tk": tks, "at": at.astype(np.int64), "n": n.astype(np.int64)})


def cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The text without the sentences in spans; its sentences; those removed."""
    words = Words([text])
    first, _ = sentences(words)
    if not spans or not first.size:
        return text, first.size, 0
    gone = np.zeros(first.size, bool)
    for s in spans:
        gone[s["at"] : s["at"] + s["n"]] = True
    edges = [*words.starts[first].tolist(), len(text)]
    out = b"".join(text[a:b] for a, b, g in zip(edges[:-1], edges[1:], gone.tolist()) if not g)
    return (text[: edges[0]] + out if out else b""), first.size, int(gone.sum())


def drop_repeats(docs: DataFrame, size_hint: int | None = None) -> DataFrame:
    """``docs`` with repeated spans removed from text, plus n_sentences and n_removed.

    size_hint: bytes of text, when known; else they are summed.
    """
    spark = docs.sparkSession
    total = size_hint if size_hint is not None else (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BIN_BYTES))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text").where("text IS NOT NULL")
    found = scatter(keyed, bins).groupBy("bin").applyInArrow(repeats, "doc_id long, tk long, at long, n long")
    spans = materialise(found.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("at", "n")).alias("spans")).select(F.col("doc_id").alias("s_id"), F.col("tk").alias("s_tk"), "spans"))
    return with_cuts(docs, spans, cut, ["n_sentences", "n_removed"])
