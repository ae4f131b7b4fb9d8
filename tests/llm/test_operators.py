"""Operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import bpe, external_shuffle, int8_dedup, langid_crf, packing, parity_join, quality_crf, sanitise, sentence_spans, sparse_suffix
from flowloom.llm.common import components, sieve
from flowloom.llm.queries import queries, vocabulary

rng = np.random.default_rng(3)
VOCAB = ["".join(rng.choice(list("abcdefghijklmnop"), int(n))) for n in rng.integers(2, 9, 3000)]


def prose(n, k=12):
    words = [str(w) for w in rng.choice(VOCAB, n)]
    return "\n".join(" ".join(words[i : i + k]).capitalize() + "." for i in range(0, n, k))


PASSAGE = prose(60)
BASE = prose(200)
NEAR = BASE.replace(BASE.split()[50], "zzz", 1)
TEXTS = [
    (1, BASE), (2, BASE), (3, NEAR), (4, prose(150)), (5, None), (6, ""), (7, "  \n "), (8, "one two"), (9, "ONE  two"), (10, "word " * 6000),
    (11, prose(40) + "\n" + PASSAGE + "\n" + prose(40)), (12, prose(80) + "\n" + PASSAGE), (13, "SHOUT!! LOUD!! " * 40), (None, prose(30)), (14, "x" * 30000), (14, "x" * 30000),
    (15, "mail a.b@c.de now 10.0.0.1 card 4111 1111 1111 1111 phone +49 (30) 123-4567 end"), (16, prose(25) + "\nLicensed.\n" + prose(25) + "\nLicensed."),
]
SCHEMA = "doc_id long, text string, extra string, n_words string, text_ string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "e", "clash", None) for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (13, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.train(docs, labels)
    got = quality_crf.quality(docs, model).collect()
    assert len(got) == len(TEXTS) and quality_crf.quality(none, model).count() == 0
    for r in got:
        w, t = words(r.text), r.text or ""
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.kept and r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert {1, 2, 3, 4, 11, 12} <= kept and 13 not in kept


def test_viterbi_is_best_path():
    import itertools

    for _ in range(50):
        s, start, trans = rng.normal(size=(5, 2)), rng.normal(size=2), rng.normal(size=(2, 2))
        score = lambda y: start[y[0]] + sum(s[i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        assert score(quality_crf.viterbi(s.tolist(), start.tolist(), trans.tolist())) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=5))))


def jaccard(rows):
    sets = []
    for _, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return Counter((i, len(s), least.get(g)) for (i, _), s, g in zip(rows, sets, group))


def test_parity_join(spark, docs, none):
    assert Counter(tuple(r) for r in parity_join.jaccard_components(docs).collect()) == jaccard(TEXTS)
    assert parity_join.jaccard_components(none).count() == 0
    kept = [r.doc_id for r in parity_join.keep_one(docs).collect()]
    assert 1 in kept and not {2, 3, 9} & set(kept) and kept.count(14) == 1 and {5, 6, 7, None} <= set(kept)


def test_parity_join_threshold(spark):
    """Pairs all around the threshold, of many sizes, and a large group of near copies."""
    rows = []
    for n in (5, 6, 7, 8, 9, 12, 18, 33, 60, 100, 210):
        base = [str(w) for w in rng.choice(VOCAB, n)]
        for _ in range(12):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, n // 25) + 1))):
                copy[int(rng.integers(n))] = str(rng.choice(VOCAB))
            copy = copy[: n - int(rng.integers(0, max(1, n // 6) + 1))]
            rows.append((len(rows) + 1, " ".join(copy)))
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == jaccard(rows)


@pytest.mark.parametrize("hot", [2, 256])
def test_parity_join_blocks(spark, monkeypatch, hot):
    """Clusters cut into blocks, with open members, and keys that count as hot."""
    monkeypatch.setattr(parity_join, "BLOCK", 4)
    monkeypatch.setattr(parity_join, "HOT", hot)
    test_parity_join_threshold(spark)


def test_parity_join_shared_passage(spark, monkeypatch):
    """Texts that share most of a passage, some linked and some not, in one cluster of many blocks."""
    monkeypatch.setattr(parity_join, "BLOCK", 3)
    monkeypatch.setattr(parity_join, "HOT", 4)
    passage = [str(w) for w in rng.choice(VOCAB, 60)]
    rows = [(i, " ".join([str(w) for w in rng.choice(VOCAB, 22)] + passage)) for i in range(12)]
    rows += [(100 + i, t + " " + str(rng.choice(VOCAB))) for i, t in rows[:5]] + [(200, " ".join(passage)), (None, rows[3][1]), (7, rows[2][1]), (7, rows[2][1])]
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == jaccard(rows)


def test_keep_one_by_id_and_text(spark, none):
    """A repeated id loses only the text that links; rows without words and clashing columns stay."""
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (3, c), (4, None), (4, None), (5, ""), (6, b + " x"), (7, prose(60)), (7, prose(60))]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, TK string, ident int").repartition(3)
    out = parity_join.keep_one(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter([(1, a), (2, b), (3, c), (4, None), (4, None), (5, ""), *rows[11:]])
    assert parity_join.keep_one(none).count() == 0


def test_segments_hold_the_bound():
    """Every pair of sizes that may link meets in a band with more segments than its largest difference."""
    for n in [*range(1, 60), 100, 333, 1000]:
        for m in range(-(-3 * n // 4), n + 1):
            mine, other = ({k: (p, d) for k, p, d in parity_join.bands(x)} for x in (n, m))
            worst = (n + m) // 7
            assert any(mine[k][0] == other[k][0] > worst and min(mine[k][1], other[k][1]) >= worst for k in mine.keys() & other.keys())


def test_components(spark):
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect())
    label = {v: v for e in edges for v in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {v: label[v] for a, b in edges if a != b for v in (a, b)}


def test_bpe_and_packing(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    odd = ["I'M it's 12³ ½ <|startoftext|>Hi<|ENDOFTEXT|> <|endoftext|>< ÀÉ é ΑΣ Σ İx y z \x85 日本語 １２ \U0001f600", "\x00<|endoftext|>", "ab" * 3000]
    coder = bpe.Coder(vocabulary())
    for t, (ids, said) in zip(odd, coder.encode([t.encode() for t in odd], decoded=True)):
        e = tok.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == e and said.decode() == tok.decode(e, skip_special_tokens=False) and coder.decode(ids) == said
    got = bpe.digests(bpe.encode_documents(docs, vocabulary())).collect()
    want = []
    for i, t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want) and bpe.encode_documents(none, vocabulary()).count() == 0

    pieces = packing.pack_documents(docs, vocabulary()).collect()
    assert packing.pack_documents(none, vocabulary()).count() == 0
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    for i, t in TEXTS:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted({(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces if p.doc_id == i and p.doc_tokens == ids.size})
        assert sum(m[1] for m in mine) == ids.size
        assert all(c == zlib.crc32(ids[s : s + n].tobytes()) for s, n, c, _ in mine)


def test_best_fit():
    sizes = sorted((int(x) for x in rng.integers(1, 101, 400)), reverse=True)
    left = []
    for n, (w, off) in zip(sizes, packing.best_fit(sizes, 100)):
        fits = [r for r in left if r >= n]
        if fits:
            assert left[w] == min(fits) and off == 100 - left[w]
        else:
            assert w == len(left) and off == 0
            left.append(100)
        left[w] -= n


def test_external_shuffle(spark, docs, none):
    out = external_shuffle.shuffle(docs, bucket_bytes=20_000)
    got = external_shuffle.digest(out).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and external_shuffle.shuffle(none).count() == 0
    assert Counter(map(tuple, external_shuffle.digest(external_shuffle.shuffle(docs, bucket_bytes=20_000)).collect())) == Counter(map(tuple, got))


def test_language(spark, docs, none):
    path = "/root/testdata/sf0.01/documents.parquet"
    real = spark.read.parquet(path)
    model = langid_crf.train(real)
    got = langid_crf.identify(real, model).where("held_out").join(real.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    blank = {r.doc_id: (r.lang_pred, r.score) for r in langid_crf.identify(docs, model).collect()}
    assert blank[5] == blank[6] == blank[7] == ("und", 0.0)
    assert langid_crf.identify(none, model).count() == 0 and langid_crf.train(none.withColumn("lang", F.lit("en"))) is None
    assert langid_crf.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_forward_backward():
    import itertools

    emit, trans, start = rng.normal(size=(4, 3)).astype(np.float32), rng.normal(size=(3, 3)), rng.normal(size=3)
    want, z = np.zeros(3), 0.0
    for y in itertools.product(range(3), repeat=4):
        p = np.exp(start[y[0]] + sum(emit[i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        z += p
        want += p * np.bincount(y, minlength=3)
    assert langid_crf.posteriors(emit, np.array([4]), trans, start)[0] == pytest.approx(want / z, rel=1e-4)


def test_int8(spark):
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.12 * rng.normal(size=(20, 16)), base[:5] * 3, np.zeros((1, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [float("nan")] * 16), (92, [1.0, None]), (93, [1.0] * 8), (94, x[0].tolist()), (94, x[0].tolist()), (None, x[1].tolist())]
    got = sorted((tuple(r) for r in int8_dedup.similar(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=16).collect()), key=str)
    vec = [np.array(v, float) if v and None not in v else np.zeros(1) for _, v in rows]
    ok = [np.isfinite(v).all() and v.any() for v in vec]
    link = np.zeros((len(rows),) * 2, bool)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and ok[a] and ok[b] and vec[a].size == vec[b].size:
                link[a, b] = vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b]) >= 0.95
    label = np.arange(len(rows))
    for _ in rows:
        label = np.array([min(label[a], *label[link[a]], label[a]) if link[a].any() else label[a] for a in range(len(rows))])
    least = {g: min((rows[a][0] for a in range(len(rows)) if label[a] == g and rows[a][0] is not None), default=None) for g in label}
    want = sorted(((i, int(link[a].sum()), least[label[a]], i is not None and i == least[label[a]]) for a, (i, _) in enumerate(rows)), key=str)
    assert got == want and int8_dedup.similar(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quantisation_bound():
    unit = rng.normal(size=(200, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    q, s, e = int8_dedup.quantise(unit)
    guess = (q.astype(float) @ q.T.astype(float)) * np.outer(s, s)
    assert (np.abs(guess - unit @ unit.T) <= e[:, None] + (1 + e[:, None]) * e[None] + 1e-12).all()


def repeated(rows, n):
    seen = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k : k + n]), set()).add((i, t, k))
    return {g: v for g, v in seen.items() if len(v) > 1}


def runs_gone(rows):
    """(id, text) to the words that go: 50-word runs other than their first occurrence, which they leave whole."""
    at = {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, TK[r[1]])):
        w = words(t)
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k : k + 50]), []).append((i, t, k))
    gone = {r: set() for r in rows}
    for v in at.values():
        i, t, f = v[0]
        for j, u, k in v[1:]:
            gone[(j, u)].update(range(max(k, f + 50) if (i, t) == (j, u) else k, k + 50))
    return gone


TK = {}


def check_suffixes(spark, rows, docs=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3) if docs is None else docs
    TK.update({r.text: r.tk for r in docs.select("text", F.xxhash64("text").alias("tk")).collect()})
    gone = runs_gone(rows)
    want = Counter((i, " ".join(x for k, x in enumerate(words(t)) if k not in gone[(i, t)]), len(gone[(i, t)])) for i, t in rows)
    got = sparse_suffix.drop_repeats(docs).collect()
    assert Counter((r.doc_id, " ".join(words(r.text)), r.n_removed) for r in got) == want
    return got


@pytest.mark.parametrize("hot", [3, 64])
def test_sparse_suffix(spark, docs, none, monkeypatch, hot):
    monkeypatch.setattr(sparse_suffix, "HOT_LEAST", hot)
    got = check_suffixes(spark, TEXTS, docs)
    assert sparse_suffix.drop_repeats(none).count() == 0
    new = {(r.doc_id, r.text) for r in got}
    assert {(1, BASE), (2, ""), (5, None), (7, "  \n "), (11, dict(TEXTS)[11])} <= new


@pytest.mark.parametrize("hot", [3, 64])
def test_sparse_suffix_partial_sharers(spark, monkeypatch, hot):
    """Documents that share fewer than 50 words of a passage hide none of its copies."""
    monkeypatch.setattr(sparse_suffix, "HOT_LEAST", hot)
    rows = []
    for k in range(25):
        p = prose(50).split()
        for j in range(2):
            rows.append((len(rows), " ".join(prose(15).split() + p + prose(15).split())))
        for _ in range(6):
            a = int(rng.integers(0, 13))
            rows.append((len(rows), " ".join(prose(15).split() + p[a : a + 38] + prose(15).split())))
    period = prose(20).split()
    rows += [(1000 + k, " ".join(period * (4 + k) + prose(10).split())) for k in range(3)]
    rows += [(None, rows[3][1]), rows[4], rows[4]]
    check_suffixes(spark, rows)


@pytest.mark.parametrize("hot", [3, 64])
def test_sparse_suffix_rows_do_not_grow_with_bins(spark, monkeypatch, hot):
    """A larger table has more bins: a document must not get more rows for that."""
    import pyarrow as pa

    monkeypatch.setattr(sparse_suffix, "HOT_LEAST", hot)
    shared = [prose(300) for _ in range(4)]
    docs = spark.createDataFrame([(k, f"{prose(20)} {shared[k % 4]}", k) for k in range(40)], "doc_id long, text string, tk long").coalesce(1)

    def rows(bins):
        parts = {}
        for r in sparse_suffix.seed_bins(docs, bins).collect():
            parts.setdefault(r.bin, []).append(bytes(r.blob))
        return sum(sparse_suffix.repeated_seeds(pa.table({"bin": [b] * len(x), "blob": x})).num_rows for b, x in parts.items())

    few = rows(2)
    assert few > 40
    assert [rows(12), rows(50)] == [few, few]


def test_sentence_spans(spark, docs, none):
    out = [(r.doc_id, r.text, r.n_removed) for r in sentence_spans.drop_repeats(docs).collect()]
    assert len(out) == len(TEXTS) and sentence_spans.drop_repeats(none).count() == 0
    new = {i: t for i, t, _ in out}
    assert new[1] == BASE and new[2] == "" and new[5] is None and new[11] == dict(TEXTS)[11] and new[16] == dict(TEXTS)[16]
    assert PASSAGE.split("\n")[1] not in new[12] and new[12].split("\n")[0] == dict(TEXTS)[12].split("\n")[0]
    # brute force: the runs of every sentence, first occurrence by (doc_id, position)
    runs, sents = {}, {}
    for i, t in TEXTS:
        if i is None or i == 14:
            continue
        s = [x for line in (t or "").split("\n") for x in re.findall(r".*?\S[.!?](?=\s|$)|.*?\S+\s*$", line) if x.split()]
        sents[i] = s
        for a in range(len(s)):
            b, n = a, len(s[a].split())
            while b + 1 < len(s) and (n < 16 or b == a) and n < 24 or b + 1 < len(s) and b > a and n < 16:
                b += 1
                n += len(s[b].split())
            if n >= 24 and b == a or n >= 16 and b > a:
                runs.setdefault(tuple(tuple(x.split()) for x in s[a : b + 1]), []).append((i, a, b))
    gone = {i: set() for i in sents}
    for v in runs.values():
        for i, a, b in sorted(v)[1:]:
            gone[i].update(range(a, b + 1))
    removed = {i: n for i, _, n in out}
    assert all(removed[i] == len(g) for i, g in gone.items() if i not in (10, 13))


def luhn(s):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_sanitise(spark, docs, none):
    odd = [
        "a@b.c_d@e.f x@y é@z.de ü a@b..c 1.2.3.4.5.6.7.8 001.002.003.004 256.1.1.1 99999999999999999999.1.1.1", "1" * 20000, "1 " * 9000, "4111-1111-1111-1111 4111 1111 1111 1112 +1 2 3 +123456789 +(12)",
        "a" * 60000 + "@", "+1.10.0.0.1 411111111111111 1", "\U0001f600 a@b.de",
    ]
    more = docs.unionByName(spark.createDataFrame([(100 + i, t, "e", "c", None) for i, t in enumerate(odd)], SCHEMA))
    got = sanitise.sanitise(more).select("doc_id", "text", sanitise.listed(F.col("base")).alias("base"), sanitise.listed(F.col("found")).alias("found")).collect()
    texts = dict(TEXTS) | {100 + i: t for i, t in enumerate(odd)}
    assert len(got) == len(TEXTS) + len(odd) and sanitise.sanitise(none).count() == 0
    assert all(r.base == base_spans(texts[r.doc_id]) for r in got)
    assert [r.text for r in got if r.doc_id == 15] == ["mail [EMAIL] now [IP] card [CARD] phone [PHONE] end"]
    assert [r.text for r in got if r.doc_id == 5] == [None] and [r.text for r in got if r.doc_id == 1] == [BASE]


def test_disclosing_terms(spark):
    """A codename that only ever stands near one address discloses it; common words do not."""
    rows = [(i, f"{prose(6)} Bluebird wrote to the boss@corp.example and the rest {prose(6)}") for i in range(8)]
    rows += [(100 + i, f"the {prose(10)} and the rest") for i in range(60)]
    got = {r.doc_id: r.text for r in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Bluebird" not in got[i] and "[NAME]" in got[i] and "the [EMAIL]" in got[i] for i in range(8))
    assert all(got[i] == t for i, t in rows if i >= 100)


@pytest.mark.parametrize("seed", range(3))
def test_disclosing_arithmetic(spark, seed):
    """The disclosing pairs of a random corpus with repeated rows, by counting over all rows in plain Python."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    mails = [f"{m}@{h}.example" for m in "abc" for h in ("x", "y")]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(3):
            mail = rng.choice([*mails, *["wz"] * 12])
            own = rng.choice(["wown" + mail[0], "wown" + mail[2:3], "wz"]) if mail in mails or rng.random() < 0.1 else rng.choice(["wowna", "wownx", "wz"])
            parts.append(" ".join([*rng.choices(words, weights=range(1, 13), k=3), own, mail]) + " end.")
        rows += [(i, " ".join(parts))] * rng.choice([1, 1, 1, 5])
    split = [[x.split() for x in re.findall(r"(.*?) end\.", t)] for _, t in rows]
    with_term, with_entity, both, places = Counter(), Counter(), Counter(), {}
    for (i, t), lines in zip(rows, split):
        with_term.update({w for x in lines for w in (*x, "end") if "@" not in w})
        seen, pairs = set(), set()
        for x in lines:
            for m in (w for w in x if "@" in w):
                for e in (f"0:{m}", f"0:group:{m.split('@')[1]}"):
                    seen.add(e)
                    places.setdefault(e, set()).add(tuple(x))
                    for w in (*x, "end"):
                        if "@" not in w:
                            pairs.add((e, w))
                            places.setdefault((e, w), set()).add(tuple(x))
        with_entity.update(seen)
        both.update(pairs)
    n, want = len(rows), set()
    for e, w in both:
        ic, pmi = math.log2(n / with_entity[e]), math.log2(both[e, w] / with_term[w] * n / with_entity[e])
        enough = len(places[e]) >= sanitise.RARE and len(places[e, w]) >= min(sanitise.SUPPORT, len(places[e]))
        if enough and pmi >= 0.5 * ic and both[e, w] / with_term[w] >= 2**-1.5:
            want.add((e, w))
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("tk", F.xxhash64("text"))
    near = sanitise.surroundings(docs.groupBy("id", "tk").agg(F.first("text").alias("text"), F.count("*").alias("copies")))
    got = sanitise.disclosing(docs, near, residual=1.5).collect()
    assert want and len(want) < len(both) and {tuple(r) for r in got} == want and len(got) == len(want)


def test_copies_disclose_no_common_words(spark):
    """Many near copies of one sentence with an address leave the words alone that mostly stand elsewhere."""
    rows = [(i, f"Osprey met the ordinary clerk {'twice' if i % 2 else 'again'} at a@copied.example today.") for i in range(60)]
    rows += [(100 + i, f"{prose(10)} an ordinary clerk met {prose(6)}") for i in range(90)]
    got = {r.doc_id: r.text for r in sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == t for i, t in rows if i >= 100)
    assert all("Osprey" not in got[i] and "ordinary clerk" in got[i] for i in range(60))


def test_registered():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries()] == [str(i) for i in range(1, 11)]


def test_pipeline(spark):
    """run() is its stages in a row, and each stage's decisions take effect."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at
        at = stage(spark, at, sf).cache()
        assert at.columns == docs.columns and at.count() <= before.count()
        if name == "n-gram Jaccard join":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            stay = {i for i, _, c in jaccard(rows) if c == i}
            assert {r.doc_id for r in at.collect()} == stay
        if name == "PII":
            assert all(base_spans(r.text) == "" for r in at.collect())
    want = corpus_pipeline.pack(spark, at, sf)
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("words", [1, 64])
def test_sieve_keeps_every_candidate(spark, words):
    rows = [(i if i % 7 else None, i * 31 - 50, f"text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, tk long, text string")
    got = {r.text for r in sieve(docs, docs.where("tk % 3 = 0").select("doc_id", "tk"), "doc_id", "tk", words=words).collect()}
    assert {t for _, tk, t in rows if tk % 3 == 0} <= got
    assert sieve(docs, docs.where("tk IS NULL"), "doc_id", "tk", words=words).isEmpty()


def test_quality_labels_lines(spark):
    """Boilerplate put into a good document is marked line by line, the rest is not."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_crf.train(real, labels)
    bad = ["$$$ ".join(prose(20).split()) + "$$$", "!! ".join(prose(15).upper().split()) + "!!"]
    wrong = 0
    for k in range(40):
        good = [prose(14) for _ in range(8)]
        at, n = int(rng.integers(0, 8)), int(rng.integers(1, 4))
        lines = good[:at] + [bad[k % 2]] * n + good[at:]
        text = "\n".join("\n".join(x.split("\n")) for x in lines)
        feats, _, _ = quality_crf.document_lines(text.encode())
        want = [int(not ("$$$" in x or "!!" in x)) for x in text.split("\n") if x.split()]
        wrong += quality_crf.content_lines(feats, model) != want
    assert wrong <= 2
    mixed = quality_crf.quality(real, model).where("n_content_lines > 0").collect()
    lines = [sum(bool(x.split()) for x in r.text.split("\n")) for r in mixed]
    assert sum(r.n_content_lines < n for r, n in zip(mixed, lines)) > 20


def test_packing_spreads_repeated_rows(spark):
    rows = [(1, "same text")] * 400 + [(2, "other")] * 5
    pieces = packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), vocabulary())
    out = packing.pack(pieces, group=50)
    assert out.count() == 405 and out.selectExpr("shiftright(sequence_id, 32) AS g").distinct().count() > 4


def test_written_shards(spark, docs, tmp_path):
    """Shards on disk hold every row at the slot that the digest names."""
    out = external_shuffle.shuffle(docs, shards=4, bucket_bytes=20_000)
    external_shuffle.write_shards(out, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter(map(tuple, back.select(out.columns).collect())) == Counter(map(tuple, out.collect()))


def test_int8_extreme_scales(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [2e-200, 4e-200]), (3, [1e200, 2e200]), (4, [1e-200, -2e-200])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in int8_dedup.similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_clashing_columns(spark):
    """Columns named like results or helpers, in another case, change nothing."""
    text = prose(60)
    rows = [(i, text if i < 3 else prose(40) + " mail a@b.de", *"abcdefghi") for i in range(6)]
    names = "N_WORDS KEPT SHARD Slot bucket TK Ident FOUND Base".split()
    odd = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    plain = odd.select("doc_id", "text")
    for f, cols in (
        (lambda d: quality_crf.quality(d, quality_crf.fit([])), ["doc_id", "n_words", "kept"]), (external_shuffle.shuffle, ["doc_id", "text"]),
        (sparse_suffix.drop_repeats, ["doc_id", "text", "n_words"]), (sentence_spans.drop_repeats, ["doc_id", "text", "n_sentences"]),
        (sanitise.sanitise, ["doc_id", "text", "found"]), (parity_join.keep_one, ["doc_id", "text"]),
    ):
        assert Counter(map(str, f(odd).select(cols).collect())) == Counter(map(str, f(plain).select(cols).collect()))


def test_sentence_spans_hash_every_run(spark):
    """The short end of a repeated passage goes too, whichever sentence is the long one."""
    long, short, mid = prose(30, 30), prose(6), prose(12)
    passages = [f"{long}\n{short}", f"{short}\n{long}", f"{mid}\n{prose(12)}\n{short}"]
    rows = [(10 * k + j, f"{prose(40, 20)}\n{p}\n{prose(40, 20)}") for k, p in enumerate(passages) for j in range(2)]
    got = {r.doc_id: r.text for r in sentence_spans.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = dict(rows)
    for k in range(3):
        ends = own[10 * k + 1].split("\n")
        assert got[10 * k + 1].split("\n") == [x for x in ends if x in ends[:2] + ends[-2:]]
    assert got[0] == own[0]


@pytest.mark.parametrize("parts", [1, 3])
def test_sentence_spans_repeated_rows(spark, parts):
    """Rows equal in id and text are one document: its first occurrence stays in each."""
    text, tail = prose(60), prose(40)
    rows = [(1, text)] * 3 + [(2, text + "\n" + tail)] * 3 + [(None, prose(40))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = Counter((r.doc_id, r.text) for r in sentence_spans.drop_repeats(docs).collect())
    assert got == Counter([(1, text)] * 3 + [(2, tail)] * 3 + rows[6:])


def test_disclosing_terms_of_rare_entities(spark):
    """Addresses that occur once share a domain: what names it goes wherever it stands."""
    rows = [(i, f"{prose(6)} The firm Hoopoe, as {prose(8)[:-1]} said, wrote from a{i}@corp.example today. {prose(6)}") for i in range(6)]
    rows += [(50, f"{prose(10)} Nobody at Hoopoe's office: Hoopoe, they said. {prose(6)}")]
    rows += [(None, f"{prose(6)} Kestrel {prose(9)[:-1]} b@rare.example plus {prose(6)}") for _ in range(2)]
    rows += [(100 + i, f"The firm, as the rest said, wrote from {prose(10)[:-1]} today. {prose(10)}") for i in range(80)]
    got = {(r.doc_id, t): r.text for (i, t), r in zip(rows, sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()) if r.doc_id == i}
    assert len(got) == len(rows)
    assert all("Hoopoe" not in v for (i, _), v in got.items() if i is not None and i < 50)
    assert "Hoopoe," not in got[rows[6]] and "[NAME], they said." in got[rows[6]]
    assert all("Kestrel" not in got[r] for r in rows[7:9])
    assert all(got[r] == r[1] for r in rows if r[0] is not None and r[0] >= 100)


def test_sentences_do_not_cut_base_spans():
    assert [re.split(sanitise.BREAK.replace("++", "+"), t) for t in ("+49. 30 123. 4567 end.", "1.2.3.4. Next! a", "a\nb.  c")] == [["+49. 30 123. 4567 end."], ["1.2.3.4.", " Next!", " a"], ["a\n", "b.", "  c"]]
