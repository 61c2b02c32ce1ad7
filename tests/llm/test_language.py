import zlib

from txnwatch.llm.language import language_id

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = language_id(docs).collect()
    assert len(out) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edge_cases(spark):
    shape = "doc_id long, text string, lang string, score int"
    rows = [(i, "the cat of the house and the dog " * 3, "en", 1) for i in range(9)] + [(20 + i, "der Hund und die Katze von dem Haus " * 3, "de", 1) for i in range(9)]
    rows += [(100, None, "en", 1), (101, "", None, 1), (102, "12 34 !?", "de", 1), (103, "der Hund " * 9000, None, 1), (None, "the cat of the house and the dog", None, 1), (103, "der Hund " * 9000, None, 1)]
    out = [r for r in language_id(spark.createDataFrame(rows, shape)).collect()]
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert [got[k].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "de", "en"]
    assert got[100].score == 0 and got[100].rejected and got[None].held_out
    assert language_id(spark.createDataFrame([], shape)).collect() == []
    assert [r.lang_pred for r in language_id(spark.createDataFrame([(1, "a word", None, 1)], shape)).collect()] == ["und"]
