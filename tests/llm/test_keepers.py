"""The near-duplicate stage where doc_ids repeat."""

import corpus_pipeline
from fieldspark.llm import neardup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, row string, repeated int, node string, kept int, _row int, lang string, source string, n_chars long"


def text(k):
    return " ".join(f"{w}{k}" for w in WORDS)


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "own", 1, "n", 2, 3, "en", "s", 4) for i, t in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_copies_under_a_kept_id_go(spark):
    a, b, c = (text(k) for k in "abc")
    assert stage(spark, [(3, a), (5, b), (5, a), (7, c)]) == sorted([(3, a), (5, b), (7, c)], key=str)


def test_groups_of_one_id_nulls_and_rows_without_words(spark):
    a, b, c = (text(k) for k in "abc")
    near = a + " more"  # 17 of 18 shingles
    rows = [(5, a), (5, near), (5, a), (5, b), (None, b), (None, c), (None, c), (None, None), (None, None), (8, ""), (8, ""), (9, " ")]
    got = stage(spark, rows)
    assert [x for x in got if x[0] == 5 and x[1] in (a, near)] in ([(5, a)], [(5, near)])
    rest = [x for x in got if not (x[0] == 5 and x[1] in (a, near))]
    assert rest == sorted([(5, b), (None, c), (None, None), (None, None), (8, ""), (8, ""), (9, " ")], key=str)
    assert stage(spark, []) == []


def test_one_keeper_a_component(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r["doc_id"] for r in neardup.keepers(docs).collect()}
    assert kept == {r["doc_id"] for r in neardup.deduplicate(docs).filter("kept").collect()}
