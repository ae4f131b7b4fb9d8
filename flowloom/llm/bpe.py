"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of all words that are new to a worker lie in one flat array.  Each
round finds the rank of the changed pairs by binary search over the sorted pair
keys, takes every word's lowest rank, merges its occurrences (leftmost first)
and drops the words that have no pair left.  Words and their ids are
remembered, so a word is merged once per worker and cache period.

The vocabulary file (a path, never copied) describes: NFC, white space to a
space, lower case; a splitting pattern that drops white space; byte-level
symbols; a word-end suffix; no decoder, so decoding joins tokens by spaces.

Defined results
  null or empty text   no ids, empty decoded text
  empty table          no rows
  ties                 of equal lowest ranks in a word the leftmost merges first
  special tokens       their strings in a text are their ids (case-sensitive)
  very long text/word  whole; rounds are linear in a word's length
  null doc_id          passed through
  repeated rows        each is returned
  extra columns        passed through by ``encode_documents``
Code points that Unicode assigned after version 16 may split otherwise than in
the tokenizers library, which knows them as unassigned.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_column, chunks

#: fixed values: the word-end suffix, and the white space class that the file's splitting pattern means by \\s
SUFFIX, SPACE = "</w>", r"\p{White_Space}"
#: words that a worker remembers, and their bytes
CACHE, CACHE_BYTES = 200_000, 16_000_000
NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class Merger:
    """Merge rounds over one flat array of symbols."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = (left << 20) | right
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + SUFFIX] for s in symbols], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each word) of non-empty words."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        buf = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[buf]
        ends = np.cumsum(size) - 1
        sym[ends] = self.final[buf[ends]]
        owner = np.repeat(np.arange(size.size), size)
        rank = np.full(sym.size, NONE, np.int32)  # of the pair that starts here
        if sym.size > 1:
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[ends] = NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while sym.size:
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, sym.size))
            over = np.repeat(low == NONE, length)
            if over.any():
                done.append((owner[over], sym[over]))
                on = ~over
                sym, owner, rank = sym[on], owner[on], rank[on]
                if not sym.size:
                    break
                live = low != NONE
                low, length = low[live], length[live]
            hit = np.flatnonzero(rank == np.repeat(low, length))
            # in a run of neighbouring hits every second one overlaps the one before
            new_run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            at = np.arange(hit.size)
            odd = (at - np.maximum.accumulate(np.where(new_run, at, 0))) & 1
            hit = hit[odd == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(sym.size, bool)
            keep[hit + 1] = False
            where = np.cumsum(keep) - 1
            hit = where[hit]
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            rank[hit] = NONE
            for i in (hit, hit[hit > 0] - 1):
                i = i[i + 1 < sym.size]
                same = owner[i] == owner[i + 1]
                rank[i[~same]] = NONE
                i = i[same]
                rank[i] = self.ranks(sym[i], sym[i + 1])
        owner = np.concatenate([o for o, _ in done]) if done else np.empty(0, np.int64)
        sym = np.concatenate([s for _, s in done]) if done else np.empty(0, np.int32)
        order = np.argsort(owner, kind="stable")
        return sym[order], np.bincount(owner, minlength=size.size)


class Coder:
    """Encodes and decodes texts (bytes) with a vocabulary file."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = dict(spec["model"]["vocab"])
        self.merger = Merger(vocab, spec["model"]["merges"])
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(r"\n|" + splitter.replace(r"\s", SPACE))  # a line break parts the words
        names = vocab | {k.decode(): v for k, v in self.special.items()}
        self.token = [b""] * (max(names.values()) + 1)
        for k, v in names.items():
            self.token[v] = k.encode()
        self.cache = cache
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.said: list[bytes | None] = []  # decoded words, filled on demand
        self.held = 0
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _store(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        k, n = len(self.at), len(words)
        while self.used + ids.size > self.flat.size:
            self.flat = np.resize(self.flat, 2 * self.flat.size)
        while k + n > self.begin.size:
            self.begin, self.size = np.resize(self.begin, 2 * self.begin.size), np.resize(self.size, 2 * self.size.size)
        self.flat[self.used : self.used + ids.size] = ids
        self.size[k : k + n] = size
        self.begin[k : k + n] = self.used + np.cumsum(size) - size
        self.used += ids.size
        self.at.update(zip(words, range(k, k + n)))
        self.said += [None] * n
        self.held += sum(map(len, words))

    def _said(self, numbers: list[int]) -> list[bytes]:
        """The decoded forms of remembered words."""
        said, name = self.said, self.token
        out = [said[i] for i in numbers]
        if None in out:
            for i in set(numbers):
                if said[i] is None:
                    a = int(self.begin[i])
                    said[i] = b" ".join([name[t] for t in self.flat[a : a + int(self.size[i])].tolist()])
            out = [said[i] for i in numbers]
        return out

    def learn(self, words: list[bytes]) -> None:
        """Encode and remember words: runs without ASCII white space."""
        plain = [w.decode() if w.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", w.decode())) for w in words]
        joined = "\n".join(plain)
        parts = self.split.findall(joined)
        index: dict[str, int] = {}
        at = np.fromiter((-1 if p == "\n" else index.setdefault(p, len(index)) for p in parts), np.int64, len(parts))
        flat, size = self.merger.merge([p.encode() for p in index]) if index else (np.empty(0, np.int32), np.empty(0, np.int64))
        begin = np.cumsum(size) - size
        word = np.cumsum(at < 0)
        real = at >= 0
        at, word = at[real], word[real]
        n = size[at]
        total = np.bincount(word, n, len(words)).astype(np.int64)
        ids = flat[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self._store(words, ids, total)

    def encode(self, texts: list[bytes], decoded: bool = False) -> list:
        """Ids (uint32) of each text; with ``decoded`` pairs of ids and decoded text."""
        if len(self.at) > self.cache or self.held > CACHE_BYTES:
            self.clear()
        split = []
        for text in texts:
            if self.cut and b"<" in text and self.cut.search(text):
                split.append([w for i, s in enumerate(self.cut.split(text)) for w in ([b"\x00" + s] if i % 2 else s.lower().split())])
            else:
                split.append(text.lower().split())
        at = self.at
        fresh: set[bytes] = set()
        for words in split:
            fresh.update(words)
        fresh = [w for w in fresh if w not in at]
        marked = [w for w in fresh if w[:1] == b"\x00" and w[1:] in self.special]
        if marked:
            self._store(marked, np.array([self.special[w[1:]] for w in marked], np.int32), np.ones(len(marked), np.int64))
            fresh = [w for w in fresh if w not in at]
        if fresh:
            self.learn(fresh)
        out = []
        for words in split:
            k = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            size = self.size[k]
            ends = np.cumsum(size)
            total = int(ends[-1]) if k.size else 0
            ids = self.flat[np.repeat(self.begin[k] - (ends - size), size) + np.arange(total)]
            if decoded:
                if (size == 0).any():
                    k = k[size > 0]
                out.append((ids, b" ".join(self._said(k.tolist()))))
            else:
                out.append(ids)
        return out

    def decode(self, ids) -> bytes:
        return b" ".join([self.token[i] for i in np.asarray(ids).tolist()])


@functools.lru_cache(maxsize=2)
def shared_coder(path: str) -> Coder:
    """The worker's coder, kept from task to task and from query to query."""
    coder = Coder(path)
    gc.freeze()  # its tables hold no cycles
    return coder


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` plus ids (array of int) and decoded (string)."""
    extra = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = T.StructType([docs.schema[c] for c in extra] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        coder = shared_coder(vocabulary)
        for batch in batches:
            texts = [t or b"" for t in binary_column(batch, "text")]
            for a, some in chunks(texts, 1_000_000):
                part = batch.slice(a, len(some))
                got = coder.encode(some, decoded=True)
                offsets = np.concatenate([[0], np.cumsum([g[0].size for g in got])]).astype(np.int32)
                flat = np.concatenate([g[0] for g in got]).astype(np.int32)
                cols = [part.column(c) for c in extra] + [pa.ListArray.from_arrays(offsets, flat), pa.array([g[1].decode() for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*extra, "ids", "decoded"])

    return docs.select(extra).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what encode_documents gives."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy().tolist()
            n, a, b = [], [], []
            for s, e, text in zip(offsets[:-1], offsets[1:], binary_column(batch, "decoded")):
                n.append(e - s)
                a.append(hashlib.sha256(flat[s:e].tobytes()).hexdigest())
                b.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", "decoded").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
