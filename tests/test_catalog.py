"""Every catalogued query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from tidefold.plans import catalog, views

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    columns = sorted(frame.columns)
    return [tuple(columns), *sorted(tuple(one(v) for v in row) for row in frame[columns].itertuples(index=False))]


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    assert plain(catalog.QUERIES[name](spark, sf).toPandas()) == plain(duck.sql(catalog.SQL[name]).df())


def test_reservations_against_a_plain_loop(spark, sf):
    attempts = catalog.attempts_v(spark, sf).where("type = 'inventory.reserve'").toPandas().sort_values(catalog.ARRIVAL)
    found: dict[tuple, list[int]] = {}
    left, applied = {}, {}
    for r in attempts.itertuples():
        stock = left.setdefault(r.sku, catalog.STOCK)
        verdict = "skipped" if applied.get(r.order_id, -1) >= r.token else "insufficient stock" if stock < r.qty else "applied"
        if verdict == "applied":
            left[r.sku] -= r.qty
            applied[r.order_id] = r.token
        n = found.setdefault((r.sku, verdict), [0, 0])
        n[0] += 1
        n[1] += r.qty
    assert {(r.sku, r.verdict): [r.n, r.qty] for r in catalog.q45(spark, sf).collect()} == found
    assert {v for _, v in found} == {"applied", "skipped", "insufficient stock"}


def test_attempts_of_a_type_leave_other_lines_out_before_the_join(spark, sf, monkeypatch):
    whole = catalog.attempts_v(spark, sf).where("type = 'inventory.reserve'")
    for words in (views.MOST_WORDS, 1):  # the second has too many words, so that all lines go to the join
        monkeypatch.setattr(views, "MOST_WORDS", words)
        found = catalog.attempts_v(spark, sf, "inventory.reserve")
        assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("ids", [[], [None], [0, 1, 63, 64, 64, -1, -64, -65, 2**63 - 1, -(2**63), 10**12, None]])
def test_lines_of_some_orders(spark, ids):
    near = sorted({max(min(i + k, 2**63 - 1), -(2**63)) for i in ids if i is not None for k in (-64, -1, 0, 1, 64)})
    lines = spark.createDataFrame([(i,) for i in [*near, *near, 7, None]], "l_orderkey long")
    orders = spark.createDataFrame([(i,) for i in ids], "o_orderkey long")
    assert sorted(r[0] for r in views.lines_of(lines, orders).collect()) == sorted(2 * [*{i for i in ids if i is not None}])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_due_filter_reaches_the_scan_and_topk_is_limited_early(spark, sf):
    plan = catalog.q01(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "LessThanOrEqual(o_orderdate" in plan
    assert "o_totalprice" not in plan
