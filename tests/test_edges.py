from scriptorium.functions.register import register
from scriptorium.operators import documents
from scriptorium.plans import vref
from scriptorium.plans.tokens import over
from scriptorium.sources.files import read_documents
from scriptorium.streaming.files import each_batch, stream_documents

TEXT = "\\id GEN x\n\\c 1\n\\p\n\\v 1 One\r\n\\v 2 Two\n"


def test_files_are_read_whole(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.usfm").write_bytes(TEXT.encode())
    docs = read_documents(spark, str(tmp_path))
    assert {r["source"] for r in docs.collect()} == {TEXT} and docs.select("doc_id").distinct().count() == 3


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.usfm").write_bytes(TEXT.encode())
    stream = stream_documents(spark, str(tmp_path / "in"))
    for name, plan in (("usj", documents.to_usj), ("vref", lambda d: over(d, lambda s, q: f"WITH {vref.verses(s, q)} SELECT ref, text FROM verses"))):
        each_batch(stream, plan, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "usj")).where("error IS NULL").count() == 1
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "vref")).collect()} == {("GEN 1:1", "One"), ("GEN 1:2", "Two")}


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, TEXT), (2, None)], "id long, source string").createOrReplaceTempView("edge_docs")
    rows = spark.sql("SELECT id, t.* FROM edge_docs, LATERAL usfm_tokens(source) t ORDER BY id, idx").collect()
    assert "".join(r["text"] for r in rows) == TEXT
    out = spark.sql("SELECT id, usfm_to_usj(source) AS j, usfm_marker_category('ft') AS c FROM edge_docs ORDER BY id").collect()
    assert out[0]["j"].startswith('{"type":"USJ"') and out[1]["j"] is None and out[0]["c"] == "NoteSubmarker"
