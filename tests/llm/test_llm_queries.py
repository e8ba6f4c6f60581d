"""Queries with SQL against DuckDB; odd and empty tables for every operator."""

import pytest
from compare import same
from pyspark.sql import functions as F

from veilframe.llm.bpe_chunks import encode_decode
from veilframe.llm.embedding_dedup import embedding_dedup
from veilframe.llm.exact_dedup import drop_duplicates, exact_dedup
from veilframe.llm.langid import language_query
from veilframe.llm.license_scan import license_scan
from veilframe.llm.mixing import mix_sources, mixed_documents
from veilframe.llm.near_join import drop_near_duplicates, jaccard_join
from veilframe.llm.quality import quality_query
from veilframe.llm.queries import ORACLES, QUERIES
from veilframe.llm.token_files import token_files
from veilframe.llm.toxicity import drop_toxic, toxicity_query


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf, name):
    same(spark, duck, sf, QUERIES[name], ORACLES[name])


def labels(spark, docs):
    return spark.createDataFrame([(1, 1, 1), (5, 1, 0), (6, 0, 1), (9, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda s, d: license_scan(d), "op2": lambda s, d: language_query(d), "op3": lambda s, d: quality_query(d, labels(s, d)), "op4": lambda s, d: jaccard_join(d), "op5": lambda s, d: mix_sources(d),
    "op6": lambda s, d: exact_dedup(d), "op7": lambda s, d: encode_decode(d), "op8": lambda s, d: token_files(d), "op9": lambda s, d: toxicity_query(d, labels(s, d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    got = OPERATORS[name](spark, odd)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, none, name):
    assert OPERATORS[name](spark, none).count() == 0


def test_no_labels_at_all(spark, odd):
    none = labels(spark, odd).where("false")
    assert {r["predicted"] for r in toxicity_query(odd, none).collect()} == {0}
    assert {r["score"] for r in quality_query(odd, none).collect()} == {0.5}


def test_odd_rows_of_stages(spark, odd):
    for stage in (drop_duplicates, drop_near_duplicates, mixed_documents, lambda d: drop_toxic(d, labels(spark, d))):
        out = stage(odd)
        assert out.columns == odd.columns
        out.collect()
    kept = drop_duplicates(odd).select("doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in kept if r["text"] == "the same text") == [2]
    assert len({r["text"] or "" for r in kept}) == len(kept)


CLASHING = "row score may maybe routed sha fp n keep size src shard times owed words source_size target taken col h ids bin meets cid gid token busy _score _fp _sha _n _keep _routed _maybe _gone _copy _id _times _source _text _y doc_id_ slot".split()


def test_clashing_columns_keep_their_values(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select("*", *(F.concat_ws("/", F.lit(c), F.col("doc_id").cast("string"), F.length("text").cast("string")).alias(c) for c in CLASHING))
    before = {tuple(r) for r in docs.collect()}
    for stage in (drop_duplicates, drop_near_duplicates, mixed_documents, lambda d: drop_toxic(d, labels(spark, d), threshold=0.9)):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = [tuple(r) for r in out.collect()]
        assert rows and set(rows) <= before
    for name, operator in OPERATORS.items():
        assert operator(spark, docs).count() == docs.count(), name


def test_null_ids_stay_in_the_mix(spark):
    docs = spark.createDataFrame([(None, "a b c", "s")] * 40 + [(i, "a b c d", "t") for i in range(40)], "doc_id long, text string, source string")
    assert mixed_documents(docs).where("doc_id is null").count() > 0


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels(spark, docs).withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(got) == (name == "odd")
        assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in odd.collect()}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [0.0, 1.0], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, None, 1), (8, [0.0, 0.0], 1), (9, [nan, 1.0], 1),
        (10, [inf, 1.0], 1), (11, [1.0, None], 1), (12, [], 1), (13, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1)).withColumn("cid", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)) and got[None][0] == 0
    assert embedding_dedup(df.where("false")).count() == 0
