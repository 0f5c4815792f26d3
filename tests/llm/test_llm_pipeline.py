import __spark_entry__
import corpus_pipeline
import pytest
from test_llm_exact import brute as brute_exact
from test_llm_mixing import brute as brute_mix
from test_llm_near import brute as brute_near
from test_llm_packing import brute_pieces, check_places, slow  # noqa: F401

from polarity.llm.common import table
from polarity.llm.quality import judge

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark, slow):  # noqa: F811
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, SF, "documents").collect()]
    rows = [r for r in rows if judge(r[1])[6]]
    keep = {k for _, k, _, _ in brute_exact(rows)}
    rows = [r for r in rows if r[0] in keep]
    stay = {i for i, _, c in brute_near(rows) if i == c}
    rows = [r for r in rows if r[0] in stay]
    size = {i: (n, taken) for i, n, _, _, taken in brute_mix(rows)}
    rows = [r for r in rows for _ in range(size[r[0]][1] // size[r[0]][0])]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == brute_pieces(slow, rows)
    check_places(got, 2048)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, edge, nothing, name, stage):
    for docs in (edge, nothing):
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.collect()
    assert stage(spark, nothing, SF).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op2_chat_format", "op4_lm_scores", "op6_exact_dedup", "op7_mix_sources"])
def test_queries_match_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    def told(df):
        return sorted([tuple(None if x != x else x for x in r) for r in df[cols].itertuples(index=False)], key=repr)
    assert told(got) == told(want)
