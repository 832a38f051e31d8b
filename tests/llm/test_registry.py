import __spark_entry__ as entry


def test_every_oracle_is_sql_of_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(isinstance(s, str) for s in oracles.values())
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries if q.startswith("op") and q[2].isdigit()} and "pipeline" in queries
