"""The pipeline's stages in a row, and the registered queries' columns."""
import corpus_pipeline
from flowlens.llm.common import read
from flowlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_narrow_down(spark):
    docs = read(spark, SF, "documents")
    extra = docs.limit(1).selectExpr("cast(null as bigint) as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")
    table = docs.union(extra).union(docs.limit(3))
    names, before = table.columns, None
    for _, step in corpus_pipeline.STAGES[:-1]:
        table = step(spark, table, SF)
        assert table.columns == names
        ids = {r.doc_id for r in table.select("doc_id").collect()}
        assert None in ids and (before is None or ids <= before)
        before = ids
    last = corpus_pipeline.STAGES[-1][1](spark, table, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == before


def test_every_operator_has_one_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10 and "pipeline" in QUERIES
