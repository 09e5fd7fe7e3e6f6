import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from keyloom.llm import quality
from keyloom.llm.queries import ORACLES, QUERIES

from .conftest import FOLDER
from .test_near import brute as near
from .test_rules import brute_hits, brute_lines
from .test_tokens import check_packing


def test_stages_against_brute_force(spark, documents, texts):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    good = {r["doc_id"] for r in quality.score_documents(documents, labels).where("kept").collect()}
    rows = [(i, t) for i, t in texts.items() if i in good]
    rows = [(i, t) for i, t, _, _ in brute_lines(rows)]
    first = {i for i, _, c in near(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in first]
    clean = {i for i, _, n, _ in brute_hits(rows, benchmark, 10) if not n}
    assert len(texts) > len(good) >= len(first) > len(clean) > 50
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: whole.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows if i in clean}
    check_packing(corpus_pipeline.run(spark, FOLDER).collect(), want, 2048)


def test_stages_keep_the_columns_of_documents(spark, documents):
    docs = documents.limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == documents.columns, name
        assert [f.dataType for f in docs.schema] == [f.dataType for f in documents.schema], name
    assert docs.where("n_chars != length(text)").count() == 0


def test_stages_take_empty_tables(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_queries():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES if q != "pipeline"}
    assert set(ORACLES) <= set(QUERIES)
