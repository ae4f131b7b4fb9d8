"""Each stage of the pipeline on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
GOOD = "The stage keeps a text that reads like prose.\n" + "\n".join(f"Sentence number {i} speaks of item {i * 7} and of matter {i * 13} at some length today." for i in range(12))
ROWS = [
    (1, GOOD), (1, GOOD), (2, GOOD + " x"), (2, "Another text under the same number. " + " ".join(f"w{i}" for i in range(60))), (None, GOOD.replace("item", "thing")), (3, None), (4, ""), (5, "  \n "),
    (6, " ".join(f"word{i}" for i in range(30000))), (7, "Write to a.b@c.de please. " + " ".join(f"v{i}" for i in range(50))),
]
NAMES = "kept N_WORDS n_removed found base tk row_ n_chars".split()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, *["c"] * (len(NAMES) - 1), 5) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES[:-1]) + ", n_chars long").repartition(3)


@pytest.mark.parametrize("k", range(4))
def test_stage(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert all(r[n] == "c" for r in out.collect() for n in NAMES[:-1])
    ids = [i for i, _ in got]
    if name == "quality rules":
        assert not {3, 4, 5} & set(ids) and ids.count(1) == 2 and ids.count(2) == 2
    elif name == "n-gram Jaccard join":
        assert sorted(map(str, ids)) == sorted(["1", "2", "3", "4", "5", "6", "7"] + (["None"] if None in ids else [])) and (2, ROWS[3][1]) in got and (2, ROWS[2][1]) not in got
    else:
        assert len(got) == len(ROWS) and (3, None) in got and (4, "") in got
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.select("text", F.col("n_chars")).collect())
    if name == "PII":
        assert not any(t and "@" in t for _, t in got)
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_last_stage(spark, odd):
    pieces = corpus_pipeline.pack(spark, odd, SF)
    assert pieces.select("doc_id").distinct().count() == 8 and pieces.where("start = 0").count() == len(ROWS)
    assert corpus_pipeline.pack(spark, odd.limit(0), SF).count() == 0
