"""Every registered query against its SQL; queries without SQL must give rows."""

import pytest

import __spark_entry__ as spark_entry
from tests.conftest import SF_DIR
from tests.oracle import connect, differences
from workload import registry

QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


# What no plan of the transit part may hold: workers outside the JVM, and joins that pair everything with everything.
FOREIGN = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin")


class Plans:
    """The plans of all that ran since this was made, also of the jobs inside a query."""

    def __init__(self, spark):
        self.store = spark._jsparkSession.sharedState().statusStore()
        self.last = max(self.ids(), default=-1)

    def ids(self):
        found = self.store.executionsList()
        return {found.apply(i).executionId(): found.apply(i) for i in range(found.size())}

    def since(self):
        return [e.physicalPlanDescription() for i, e in self.ids().items() if i > self.last]


def check_plans(name, plans):
    found = plans.since()
    assert found
    if name in registry.QUERIES:
        assert [w for w in FOREIGN if any(w in text for text in found)] == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    plans = Plans(spark)
    assert differences(con, QUERIES[name](spark, SF_DIR), SQL[name]) == []
    check_plans(name, plans)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    plans = Plans(spark)
    assert QUERIES[name](spark, SF_DIR).limit(1).count() == 1
    check_plans(name, plans)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    top = spark_entry.entry(spark)
    assert top.columns == ["feed", "trip_id", "delay_min", "timestamp"]
    assert top.count() == 20
