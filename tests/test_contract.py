import re

import __spark_entry__ as entry_module


def test_names_and_checks_line_up():
    queries, checks = entry_module.queries(), entry_module.oracle_sql()
    own = {n for n in queries if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert set(checks) <= set(queries) and len(own) > 150


def test_flagship(spark):
    rows = entry_module.entry(spark).collect()
    assert {r["risk_category"] for r in rows} <= {"low", "medium", "high"} and sum(r["rows"] for r in rows) > 0
