import duckdb

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import brute as removed
from tests.llm.test_near_dedup import brute as components
from tests.llm.test_near_dedup import sets
from txnwatch.llm.passages import quality_scores
from txnwatch.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"


def test_same_as_brute_force_stages(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in quality_scores(docs, labels).collect() if r.predicted == 1}
    rows = {r.doc_id: r.asDict() for r in docs.collect() if r.doc_id in good}
    for doc, (n, gone) in removed([(k, r["text"]) for k, r in rows.items()]).items():
        if n and len(gone) == n:
            del rows[doc]
        elif gone:
            text = "\n".join(x for i, x in enumerate(rows[doc]["text"].split("\n")) if i not in set(gone))
            rows[doc] |= {"text": text, "n_chars": len(text)}
    near = components([(k, r["text"]) for k, r in rows.items()], width=5)
    rows = {k: r for k, r in rows.items() if not sets(r["text"], 5) or near[k][1] == k}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = leaks([(k, r["text"]) for k, r in rows.items()], items)
    rows = {k: r for k, r in rows.items() if not found[k]}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(k, r["text"], r["source"]) for k, r in rows.items()])
    want = sorted((r[0], r[2], r[3], r[4], r[5]) for r in con.sql(SQL["op2_mixing"]).fetchall() if r[5] > 0)
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in out) == want
    assert all(rows[r.doc_id] == {c: r[c] for c in docs.columns} for r in out)


def test_stages_take_odd_tables(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, row string, t int"
    for rows in [], [(None, None, None, None, None, None, None), (1, "", "en", None, 0, "x", 1), (1, "a b c d e f", "en", "s", 11, "x", 1), (1, "a b c d e f", "en", "s", 11, "x", 1)]:
        docs = spark.createDataFrame(rows, shape)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns and out.count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() <= len(rows)
