import glob
import os

import duckdb
import pytest
from corpus import DOC_SCHEMA, WORD, documents
from test_dedup import linked
from test_text_stages import contaminated

import corpus_pipeline
from punctual.llm import minhash, quality_rules
from punctual.llm.queries import QUERIES, SQL
from tests_rows import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame, answer = QUERIES[name](spark, SF), con.execute(SQL[name])
    names = [c[0] for c in answer.description]
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, answer.fetchall())


def test_ten_queries():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and set(SQL) <= set(QUERIES)


def test_stages_one_by_one(spark, tmp_path):
    rows = documents(seed=8)
    words = rows[40][1].split()
    items = [(1, " ".join(words[2:20])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        after = [tuple(r) for r in out.collect()]
        if name == "quality_rules":
            kept = {(r.doc_id, r.text_key) for r in quality_rules.judge(docs).filter("kept").collect()}
            assert {r[0] for r in after} == {i for i, _ in kept} and 0 < len(after) < len(before)
        elif name == "near_dedup":
            want = {i for i, _, least, _ in linked(before, 80) if i == least}
            assert {r[0] for r in after} == want and len(after) == len(want)
        elif name == "decontamination":
            clean = {x[0] for x in contaminated(before, items) if not x[-1]}
            assert {r[0] for r in after} == clean and len(clean) < len(before)
        elif name == "pseudonyms":
            assert {r[0] for r in after} == {r[0] for r in before} and all(r[4] == len(r[1]) for r in after)
        else:
            assert {r[0] for r in after} == {r[0] for r in before}
            assert all(r.size == len(WORD.findall(t[1] or "")) for r, t in zip(out.orderBy("doc_id").collect(), sorted(before)))
        if name != "mixing":
            assert out.columns == docs.columns
        docs = corpus_pipeline.saved(out, "stage")


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_minhash_has_no_blind_spot_at_its_thresholds():
    for percent, least in ((80, 1e-6), (85, 1e-9)):
        assert (1 - (percent / 100) ** minhash.ROWS) ** minhash.BANDS < least
