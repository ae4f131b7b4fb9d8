"""Language identification by a linear-chain CRF over words.

A word's score for each language sums learned weights of its affixes (1 to 3
letters), letter n-grams (2 and 3) and, for words of the learned lexicon, the
word itself.  Learned transitions tie neighbouring words.  Forward-backward
gives each word's posterior, so code-switched text is labelled word by word; a
document takes the language with the largest mean posterior, which is its
score.  Chains are the lines of a text, cut every CHAIN words.

Defined results
  empty table            no rows
  null text, no letter   ``und`` with score 0
  nothing to learn from  ``und`` with score 0
  very long text         whole
  ties                   the alphabetically first language
  null doc_id            predicted; never trained on
  repeated rows          each is predicted
  extra columns          ignored
"""

from __future__ import annotations

import gc
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, chunks

#: bounded training sample: documents, and lines picked by hash from all over their texts
TRAIN_DOCS, TRAIN_LINES = 800, 8000
DIM, LEXICON, CHAIN, CACHE = 1 << 15, 4000, 96, 200_000
#: bytes of the words that a worker remembers
CACHE_BYTES = 16_000_000
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())


def features(word: str, lexicon: dict[str, int]) -> np.ndarray:
    """Indices of a lower-case word's features."""
    parts = [f"^{word[:n]}" for n in (1, 2, 3)] + [f"{word[-n:]}$" for n in (1, 2, 3)]
    parts += [word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)]
    out = [zlib.crc32(p.encode()) % DIM for p in parts]
    if word in lexicon:
        out.append(DIM + lexicon[word])
    return np.array(out)


def core(word: bytes) -> str:
    """The word as features see it: no outer punctuation, lower case; empty without a letter."""
    w = word.decode("utf-8", "replace").strip(EDGE).lower()
    return w if any(c.isalpha() for c in w) else ""


def posteriors(emit: np.ndarray, size: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward: sums over each chain of its words' posteriors.

    emit: scores of all words, chain after chain; size: words of each chain.
    """
    order = np.argsort(-size, kind="stable")
    begin, n = (np.cumsum(size) - size)[order], size[order]
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    t = np.exp(trans)
    longest = int(n[0])
    live = np.searchsorted(-n, -np.arange(longest), side="left")
    fwd = np.zeros_like(e)
    a = None
    for i in range(longest):
        k = live[i]
        at = begin[:k] + i
        a = (np.exp(start) if i == 0 else a[:k] @ t) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        fwd[at] = a
    total = np.zeros((size.size, emit.shape[1]))
    b = np.ones((size.size, emit.shape[1]), e.dtype)
    for i in range(longest - 1, -1, -1):
        k = live[i]
        at = begin[:k] + i
        g = fwd[at] * b[:k]
        total[:k] += g / g.sum(axis=1, keepdims=True)
        new = (b[:k] * e[at]) @ t.T
        b[:k] = new / new.sum(axis=1, keepdims=True)
    out = np.empty_like(total)
    out[order] = total
    return out


def fit(texts: list[tuple[str, str]], epochs: int = 4, length: int = 16, rate: float = 0.3, seed: int = 7) -> dict | None:
    """Maximum likelihood by Adagrad over chains of ``length`` words.

    Half of the chains are spliced from two documents, so that transitions
    learn of code-switching.
    """
    langs = sorted({lang for _, lang in texts})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    docs = []
    for text, lang in texts:
        words = [c for w in text.encode().split() if (c := core(w))]
        if words:
            docs.append((words, langs.index(lang)))
    if not docs:
        return None
    count: dict[str, int] = {}
    for words, _ in docs:
        for w in words:
            count[w] = count.get(w, 0) + 1
    lexicon = {w: i for i, w in enumerate(sorted(count, key=lambda w: (-count[w], w))[:LEXICON])}
    vocab = {w: i for i, w in enumerate(sorted(count))}
    feats = [features(w, lexicon) for w in vocab]
    size = np.array([f.size for f in feats])
    flat, first = np.concatenate(feats), np.cumsum(size) - size
    pieces: list[list[tuple[int, int]]] = []
    for words, lang in docs:
        pieces += [[(vocab[w], lang) for w in words[i : i + length]] for i in range(0, len(words) - length + 1, length)]
    if not pieces:
        pieces = [[(vocab[w], lang) for w in (words * length)[:length]] for words, lang in docs]
    spliced = []
    for p in pieces:
        if rng.random() < 0.5:
            cut = int(rng.integers(1, length))
            p = p[:cut] + pieces[int(rng.integers(len(pieces)))][cut:]
        spliced.append(p)
    data = np.array(spliced)
    k = len(langs)
    w, trans, start = np.zeros((DIM + LEXICON, k)), np.zeros((k, k)), np.zeros(k)
    seen = [np.full_like(x, 1e-6) for x in (w, trans, start)]
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(data)), max(1, len(data) // 128)):
            ids, y = data[batch, :, 0], data[batch, :, 1]
            words, where = np.unique(ids, return_inverse=True)
            n = size[words]
            at = np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = np.repeat(np.arange(words.size), n)
            score = np.zeros((words.size, k))
            np.add.at(score, own, w[flat[at]])
            e = score[where.reshape(ids.shape)]
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
            fwd[:, 0] = start + e[:, 0]
            for t in range(1, length):
                fwd[:, t] = lse(fwd[:, t - 1, :, None] + trans, 1) + e[:, t]
            for t in range(length - 2, -1, -1):
                bwd[:, t] = lse(trans + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            z = lse(fwd[:, -1], 1)
            post = np.exp(fwd + bwd - z[:, None, None])
            pair = np.exp(fwd[:, :-1, :, None] + trans + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
            gold = np.eye(k)[y]
            diff = gold - post
            per_word = np.zeros((words.size, k))
            np.add.at(per_word, where.reshape(-1), diff.reshape(-1, k))
            used, back = np.unique(flat[at], return_inverse=True)
            g = np.zeros((used.size, k))
            np.add.at(g, back, per_word[own])
            g /= len(batch)
            seen[0][used] += g * g
            w[used] += rate * g / np.sqrt(seen[0][used])
            gold_pair = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
            for p, s, g in ((trans, seen[1], (gold_pair - pair) / len(batch)), (start, seen[2], diff[:, 0].sum(0) / len(batch))):
                s += g * g
                p += rate * g / np.sqrt(s)
    return {"langs": langs, "lexicon": lexicon, "w": w.astype(np.float32), "trans": trans.astype(np.float32), "start": start.astype(np.float32)}


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> dict | None:
    """Fit on at most ``limit`` labelled documents outside the held-out fold, in hash order."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # ids first: a task's candidates for the sample are then a few bytes each
    picked = [r[0] for r in labelled.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(limit).collect()]
    if not picked:
        return None
    lines = labelled.where(F.col("doc_id").isin(picked)).select("doc_id", "lang", F.xxhash64("text").alias("tk"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = lines.orderBy(F.xxhash64("doc_id", "at", "line"), "doc_id", "lang", "tk", "at").limit(TRAIN_LINES).collect()
    texts: dict[tuple, list] = {}
    for r in rows:
        texts.setdefault((r.doc_id, r.tk, r.lang), []).append((r["at"], r.line))
    return fit([("\n".join(line for _, line in sorted(some)), lang) for (_, _, lang), some in sorted(texts.items())])


class Labeller:
    """Emission scores of words, remembered."""

    def __init__(self, model: dict):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.held = 0
        self.emit = np.zeros((1 << 14, len(self.model["langs"])), np.float32)
        self.real = np.zeros(1 << 14, bool)

    def learn(self, words: list[bytes]) -> None:
        n = len(self.at)
        while n + len(words) > self.real.size:
            self.emit, self.real = np.concatenate([self.emit, np.zeros_like(self.emit)]), np.concatenate([self.real, np.zeros_like(self.real)])
        w, lexicon = self.model["w"], self.model["lexicon"]
        feats = []
        for i, word in enumerate(words):
            c = core(word)
            if c:
                self.real[n + i] = True
                feats.append(features(c, lexicon))
        if feats:
            size = np.array([f.size for f in feats])
            self.emit[n : n + len(words)][self.real[n : n + len(words)]] = np.add.reduceat(w[np.concatenate(feats)], np.cumsum(size) - size)
        self.at.update(zip(words, range(n, n + len(words))))
        self.held += sum(map(len, words))

    def label(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if len(self.at) > CACHE or self.held > CACHE_BYTES:
            self.clear()
        lines = [[line.split() for line in t.split(b"\n")] for t in texts]
        fresh = {w for doc in lines for line in doc for w in line if w not in self.at}
        if fresh:
            self.learn(sorted(fresh))
        at = self.at
        ids, line_of, doc_of, n_lines = [], [], [], 0
        for d, doc in enumerate(lines):
            for line in doc:
                if line:
                    ids.append(np.fromiter(map(at.__getitem__, line), np.int64, len(line)))
                    line_of.append(len(line))
                    doc_of.append(d)
        langs = self.model["langs"]
        if not ids:
            return [("und", 0.0)] * len(texts)
        flat = np.concatenate(ids)
        line = np.repeat(np.arange(len(line_of)), line_of)
        keep = self.real[flat]
        flat, line = flat[keep], line[keep]
        if not flat.size:
            return [("und", 0.0)] * len(texts)
        fresh_line = np.concatenate([[True], line[1:] != line[:-1]])
        place = np.arange(flat.size) - np.maximum.accumulate(np.where(fresh_line, np.arange(flat.size), 0))
        starts = np.flatnonzero(place % CHAIN == 0)
        size = np.diff(np.append(starts, flat.size))
        total = posteriors(self.emit[flat], size, self.model["trans"], self.model["start"])
        doc = np.array(doc_of)[line[starts]]
        sums, count = np.zeros((len(texts), len(langs))), np.bincount(doc, size, len(texts))
        np.add.at(sums, doc, total)
        out = []
        for s, c in zip(sums, count.tolist()):
            k = int(np.argmax(s))
            out.append((langs[k], min(1.0, float(s[k] / c))) if c else ("und", 0.0))
        return out


_KEPT: dict[str, Labeller] = {}


def shared_labeller(key: str, model: dict) -> Labeller:
    """The worker's labeller for a model, kept from task to task."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Labeller(model)
        gc.freeze()  # the model holds no cycles
    return _KEPT[key]


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score).  Map-only; the model is the closure."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        made = shared_labeller(key, shared.value) if shared.value else None
        for batch in batches:
            out = []
            for _, texts in chunks(binary_column(batch, "text"), 2_000_000):
                out += made.label(texts) if made else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
