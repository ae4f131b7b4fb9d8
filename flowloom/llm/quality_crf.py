"""Quality rules: a linear-chain CRF labels lines as content or boilerplate.

``quality(docs, model)`` adds to every document the base counts and the verdict
of the method: Viterbi decoding labels each line that holds a word, and the
share of words in content lines decides whether the document is kept.

Labels are given for documents, not lines, so the fit has two steps.  Every
line first takes its document's label and a classifier of single lines is
fitted.  In documents of quality 0 the lines that it reads as content then
change sides, and the CRF is fitted on these chains and on chains spliced of a
good and a bad document, so that its transitions have seen labels switch.

Defined results
  empty table          no rows
  null or empty text   counts 0, content_share 0, base_failed and not kept
  no line with a word  as empty
  very long text       processed whole
  ties in Viterbi      content wins
  nothing to learn     fixed weights
  repeated rows        each row gets its own (equal) result
  extra columns        passed through; columns named like a result (in any case) are replaced
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SOLID, STEP, Words, binary_column, chunks, mix, result_columns, window_hashes

#: fixed values of the base rules
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: documents the CRF is fitted on (a bounded sample of the labelled rows)
TRAIN_DOCS = 800
#: lines of a chain of the fit (documents are cut into chains, to the end), and chains, picked by hash
CHAIN_LINES, TRAIN_CHAINS = 40, 4000
#: least share of words in content lines
CONTENT_SHARE = 0.5

UPPER = bytes(range(65, 91))
ALPHA = UPPER + bytes(range(97, 123))
N_FEATURES = 9
RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("n_content_lines", T.LongType()), T.StructField("kept", T.BooleanType())]
)


def repeated_words(words: Words) -> np.ndarray:
    """For each text, its words inside 8-word windows that occur twice or more in it."""
    total = np.zeros(words.first.size - 1, np.int64)
    h = window_hashes(words.codes, WINDOW)
    if not h.size:
        return total
    owner = words.owner()
    inside = owner[: h.size] == owner[WINDOW - 1 :]
    key = mix(h + owner[: h.size].astype(np.uint64) * STEP)
    ranked = np.sort(key[inside])
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not twice.size:
        return total
    at = np.minimum(np.searchsorted(twice, key), twice.size - 1)
    starts = np.flatnonzero((twice[at] == key) & inside)
    edge = np.zeros(owner.size + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return np.bincount(owner, np.cumsum(edge)[:-1] > 0, total.size).astype(np.int64)


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[float]:
    n = len(words)
    alpha = len(line) - len(line.translate(None, ALPHA))
    upper = len(line) - len(line.translate(None, UPPER))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    return [
        1.0,
        min(symbols / n, 3.0),
        min(line.count(b"!") / n, 3.0),
        upper / alpha if alpha else 0.0,
        1.0 - len(set(words)) / n if n > 3 else 0.0,
        float(seen),
        float(n <= 3),
        float(line.rstrip()[-1:] in b".?!"),
        min(n, 40) / 40.0,
    ]


def document_lines(text: bytes) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines with a word, and the duplicate lines."""
    seen: set[bytes] = set()
    feats, sizes, dup = [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            dup += again
            seen.add(line)
            feats.append(line_features(line, words, again))
            sizes.append(len(words))
    return feats, sizes, dup


def viterbi(scores: list[list[float]], start: list[float], trans: list[list[float]]) -> list[int]:
    """Best labels (1 content, 0 boilerplate) for one chain of line scores."""
    (t00, t01), (t10, t11) = trans
    a, b = start[0] + scores[0][0], start[1] + scores[0][1]
    back = []
    for s0, s1 in scores[1:]:
        x0, y0, x1, y1 = a + t00, b + t10, a + t01, b + t11
        back.append((1 if y0 >= x0 else 0, 1 if y1 >= x1 else 0))
        a, b = (y0 if y0 >= x0 else x0) + s0, (y1 if y1 >= x1 else x1) + s1
    label = 1 if b >= a else 0
    out = [label]
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(chains: list[tuple[np.ndarray, np.ndarray]], steps: int = 80, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """Maximum likelihood by forward-backward and Adagrad over all chains at once.

    chains: (features of the lines, label of each line).  No chain: the fixed
    prior below, which reads symbols, shouting and repetition as boilerplate.
    """
    if not chains:
        w = np.zeros((N_FEATURES, 2))
        w[:, 1] = [2.0, -6.0, -6.0, -3.0, -4.0, -1.0, 0.0, 0.5, 0.5]
        return {"w": w.tolist(), "start": [0.0, 0.0], "trans": [[0.5, -0.5], [-0.5, 0.5]]}
    longest, n = max(len(y) for _, y in chains), len(chains)
    x = np.zeros((n, longest, N_FEATURES))
    y = np.zeros((n, longest), int)
    live = np.zeros((n, longest), bool)
    for i, (f, lab) in enumerate(chains):
        x[i, : len(lab)], y[i, : len(lab)], live[i, : len(lab)] = f, lab, True
    par = [np.zeros((N_FEATURES, 2)), np.zeros(2), np.zeros((2, 2))]
    seen = [np.full_like(p, 1e-8) for p in par]
    gold = np.eye(2)[y] * live[..., None]
    follow = live[:, 1:]
    gold_pairs = np.einsum("nti,ntj->ij", gold[:, :-1] * follow[..., None], gold[:, 1:])
    total = live.sum()
    for _ in range(steps):
        w, start, trans = par
        e = x @ w
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            step = log_sum(fwd[:, t - 1, :, None] + trans, 1) + e[:, t]
            fwd[:, t] = np.where(live[:, t, None], step, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = log_sum(trans + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(live[:, t + 1, None], step, 0.0)
        z = log_sum(fwd[:, -1], 1)
        post = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
        pair = np.exp(fwd[:, :-1, :, None] + trans + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * follow[..., None, None]
        grads = [
            np.einsum("ntk,nti->ki", x, gold - post) / total - decay * w,
            (gold[:, 0] - post[:, 0]).sum(0) / total,
            (gold_pairs - pair.sum((0, 1))) / total - decay * trans,
        ]
        for p, s, g in zip(par, seen, grads):
            s += g * g
            p += rate * g / np.sqrt(s)
    return {"w": par[0].tolist(), "start": par[1].tolist(), "trans": par[2].tolist()}


def line_weights(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Logistic weights of single lines, both labels counting the same."""
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(steps):
        g = x.T @ ((y - 1 / (1 + np.exp(-x @ w))) * share) - decay * w
        seen += g * g
        w += rate * g / np.sqrt(seen)
    return w


def line_labels(chains: list[tuple[np.ndarray, int]], seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chains with a label for each line, and as many spliced of a good and a bad one."""
    x, y = np.concatenate([f for f, _ in chains]), np.concatenate([np.full(len(f), q) for f, q in chains])
    w = line_weights(x, y) if 0 < y.mean() < 1 else np.zeros(x.shape[1])
    out = [(f, np.ones(len(f), int) if q else (f @ w > 0).astype(int)) for f, q in chains]
    good, bad = ([c for c, (_, q) in zip(out, chains) if q == k] for k in (1, 0))
    # of the bad ones only their boilerplate is spliced
    bad = [(f[lab == 0], lab[lab == 0]) for f, lab in bad if (lab == 0).any()]
    if not good or not bad:
        return out
    rng = np.random.default_rng(seed)
    for _ in range(len(out)):
        (f, lab), (g, low) = good[rng.integers(len(good))], bad[rng.integers(len(bad))]
        at, n = int(rng.integers(len(f) + 1)), 1 + int(rng.integers(len(g)))
        g, low = g[:n], low[:n]
        out.append((np.concatenate([f[:at], g, f[at:]]), np.concatenate([lab[:at], low, lab[at:]])))
    return out


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> dict:
    """Fit the CRF on at most ``limit`` labelled documents, taken in hash order.

    Their lines become features in the executors; at most TRAIN_CHAINS chains
    of CHAIN_LINES lines, picked by hash, reach the driver.
    """
    picked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(limit)
        .collect()
    )
    if not picked:
        return fit([])
    known = {r.doc_id: r.quality for r in picked}

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary_column(batch, "text")):
                feats = document_lines(text)[0]
                for k in range(0, len(feats), CHAIN_LINES):
                    rows.append((doc_id, k, np.array(feats[k : k + CHAIN_LINES], np.float32).tobytes()))
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["doc_id", "k", "feats"])

    texts = docs.where(F.col("doc_id").isin(list(known)) & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.mapInArrow(run, "doc_id long, k long, feats binary").orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k", "feats").limit(TRAIN_CHAINS).collect()
    chains = [(np.frombuffer(r.feats, np.float32).reshape(-1, N_FEATURES).astype(float), known[r.doc_id]) for r in rows]
    return fit(line_labels(chains)) if chains else fit([])


def content_lines(feats: list[list[float]], model: dict) -> list[int]:
    """1 (content) or 0 (boilerplate) for each line of a document."""
    return viterbi((np.array(feats) @ np.asarray(model["w"])).tolist(), model["start"], model["trans"]) if feats else []


def quality(docs: DataFrame, model: dict, share: float = CONTENT_SHARE) -> DataFrame:
    """All columns of ``docs`` plus RESULT.  Map-only: no shuffle."""
    names = [f.name for f in RESULT]
    extra = result_columns(docs, names)
    schema = T.StructType([docs.schema[c] for c in extra] + RESULT.fields)
    model = json.loads(json.dumps(model))

    def run(batches):
        fitted = model | {"w": np.array(model["w"])}
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.bool_()]
        for batch in batches:
            out = []
            for _, texts in chunks(binary_column(batch, "text")):
                words = Words(texts)
                spaces = np.add.reduceat(~SOLID[np.frombuffer(words.joined, np.uint8)], words.begin[:-1]) - 1
                counts, repeats = np.diff(words.first).tolist(), repeated_words(words).tolist()
                for text, n, again, blank in zip(texts, counts, repeats, spaces.tolist()):
                    symbols = len(text) - len(text.translate(None, SYMBOLS))
                    if not n:
                        out.append((0, 0, symbols, 0, 0, True, 0.0, 0, False))
                        continue
                    feats, sizes, dup = document_lines(text)
                    failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
                    labels = content_lines(feats, fitted)
                    content = sum(s for s, k in zip(sizes, labels) if k) / n
                    out.append((n, len(text.decode()) - blank, symbols, dup, again, failed, content, sum(labels), not failed and content >= share))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in extra] + cols, names=extra + names)

    return docs.select(extra).mapInArrow(run, schema)
