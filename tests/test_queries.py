"""Every query of the core against its SQL, over whole tables."""

import os

import pytest

from tessera.jobs import registry
from tests.oracle import assert_same

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


#: Queries of the core that SQL can't say, and the tests that hold them against brute force: none.
TESTED_ELSEWHERE: dict[str, str] = {}


def test_all_core_queries_are_registered_once():
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(registry.QUERIES) <= set(found) and set(registry.QUERIES) - set(registry.ORACLES) == set(TESTED_ELSEWHERE)
    assert set(sql) <= set(found) and all(callable(f) for f in found.values())


@pytest.mark.parametrize("name", ["provider_validation", "binary_size_filter", "glob_filter", "import_candidate_resolution", "scan_diagnostics", "graph_slice", "related_chunks", "golden_eval"])
def test_results_say_something(spark, name):
    """Every kind of outcome occurs: a comparison of constant or empty columns would prove little."""
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows
    for column in {"binary", "one", "deep", "reason", "role", "why", "baseline", "included"} & set(rows[0].asDict()):
        assert len({r[column] for r in rows}) > 1, column
    if name == "import_candidate_resolution":
        assert len({(r.target or "").rpartition(".")[2] for r in rows}) > 2
