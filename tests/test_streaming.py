from tracewright.functions.register import register_functions
from tracewright.streaming.incremental import index_stream

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron".split()


def test_new_documents_meet_known_ones(spark, tmp_path):
    def drop(name, rows):
        spark.createDataFrame(rows, "doc string, text string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        docs = spark.readStream.schema("doc string, text string").parquet(str(tmp_path / "in/*"))
        query = index_stream(docs, "doc", "text", str(tmp_path / "index"), str(tmp_path / "matches"), str(tmp_path / "state"))
        query.awaitTermination(120)
        return {(r.doc_a, r.doc_b) for r in spark.read.parquet(str(tmp_path / "matches")).collect()}

    text = " ".join(WORDS)
    drop("one", [("a", text), ("b", text + " x y"), ("c", "nothing alike here at all in this one"), ("n", None)])
    assert run() == {("a", "b")}
    drop("two", [("d", "z " + text)])
    assert run() == {("a", "b"), ("d", "a"), ("d", "b")}


def test_functions_in_sql(spark):
    register_functions(spark)
    row = spark.sql("SELECT tw_strip_comments('x # y', '.py') AS s, tw_indel_ratio('abc', 'abd') AS r, tw_fnv('a') AS f").first()
    assert row.s == "x " and round(row.r, 1) == 66.7 and row.f > 0
    assert spark.sql("SELECT * FROM tw_opcodes('a\\nb', 'a\\nc')").count() == 2
    assert spark.sql("SELECT * FROM tw_winnow('a b c d e f g h i j', 5, 4)").count() > 0
