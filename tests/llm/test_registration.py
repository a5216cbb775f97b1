import __spark_entry__
import bench
from quire.llm.queries import ORACLE_SQL, QUERIES


def test_operators_and_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) and set(ORACLE_SQL) <= set(QUERIES)


def test_bench_leaves_the_operators_to_the_check_tool():
    names = list(__spark_entry__.queries())
    assert set(names) - set(bench.headline(names)) == set(QUERIES) | {"pipeline"}
