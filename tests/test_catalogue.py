"""Every query of the catalogue against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, small, name):
    df = catalogue.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = ordered([tuple(cell(r[c]) for c in columns) for r in df.collect()])
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == ordered([tuple(cell(r[i]) for i in at) for r in cursor.fetchall()])


def test_choice_goes_on_behind_a_crowded_head(spark, tmp_path):
    """Sixty dear parts of one name and sixty near vectors of one label take their share only."""
    parts = [("b", i, "hot ring" if i < 60 else f"plain kind{i}", 1000.0 - i) for i in range(70)]
    spark.createDataFrame(parts, "p_brand string, p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    picks = catalogue.greedy_dedup_topk(spark, str(tmp_path)).orderBy("pick").collect()
    assert [r["p_partkey"] for r in picks] == [0, 60, 61, 62, 63]
    turn = [i / 100 for i in range(90)]
    vectors = [(i, [math.cos(t), math.sin(t)], 0 if i < 70 else i % 7) for i, t in enumerate(turn)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for found, n in ((catalogue.group_cap_topk(spark, str(tmp_path)), 10), (catalogue.flagship_recommend(spark, str(tmp_path)), 5)):
        assert {r["n"] for r in found.groupBy("query_id").count().withColumnRenamed("count", "n").collect()} == {n}


def test_entry_has_no_need_of_the_llm_operators(spark):
    import subprocess
    import sys

    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'flagship_recommend' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
