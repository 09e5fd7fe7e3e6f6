import zlib

import numpy as np
import pyarrow as pa

from keyloom.llm import langid

from .conftest import EDGE


def test_held_out_accuracy(documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    got = langid.identify(documents).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 30
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_edge_cases(spark, edge, empty):
    lettered = {i for i, t, _ in EDGE if any(c.isalpha() for c in t or "")}
    got = langid.identify(edge.withColumnRenamed("source", "lang")).collect()
    for r in got:
        assert (r["lang_pred"] != "und") == (r["doc_id"] in lettered)
        assert r["lang_pred"] in "abcde" or r["score"] == 0 and not r["accepted"]
    nothing = langid.identify(edge.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert langid.identify(empty.withColumnRenamed("source", "lang")).count() == 0


def test_subwords_stay_in_their_text():
    alone = [next(langid.bags(pa.array([t])))[1][0] for t in ("ab c", "", "é1x", "zz")]
    together = next(langid.bags(pa.array(["ab c", "", "é1x", "zz"])))[1]
    assert np.array_equal(np.array(alone), together)
    bucket, owner = langid.subwords(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))
    assert len(bucket) == 2 + 3 + 2 + 1 and set(owner.tolist()) == {0}  # a b | _a ab b_ | _ab ab_ | _ab_


def test_training_never_sees_held_out_rows(documents):
    sample = langid.labelled_sample(documents, "doc_id", "text", "lang", 10)
    assert max(r["count"] for r in sample.groupBy("label").count().collect()) <= 10


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "one text", 0.5, "x"), (1, "one text", 0.5, "x")], "doc_id long, text string, score double, lang_pred string")
    out = langid.predict(df, None)
    assert out.columns == ["doc_id", "score", "lang_pred", "lang_pred_", "score_", "accepted"]
    assert [tuple(r) for r in out.select("score", "lang_pred_", "score_").collect()] == [(0.5, "und", 0.0)] * 2
    assert langid.predict(df.limit(0), None).count() == 0
