import duckdb

from pathloom.llm import queries

DIR = "/root/testdata/sf0.001"


def test_topk_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DIR}/embeddings.parquet')")
    result = con.execute(queries.oracle_sql()["op4_topk"])
    names = [d[0] for d in result.description]
    want = sorted(result.fetchall())
    frame = queries.op4_topk(spark, DIR).select(*names)
    assert frame.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert [str(d[1]) for d in result.description] == ["BIGINT", "INTEGER", "BIGINT", "BIGINT"]
    assert sorted(tuple(r) for r in frame.collect()) == want and want
