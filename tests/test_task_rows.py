"""Shuffles whose tasks are counted by rows, so none grows with the input."""

import datetime as dt
import re

from turnlens.plans import catalog


def test_copy_normalised_rate_deals_lines_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_ROWS", 50, raising=False)
    day = dt.datetime(2024, 1, 1)
    # 400 lines of 100 orders on two days each, one line twice
    lines = [(i // 4, 2.0, 10.0, day + dt.timedelta(days=i % 2)) for i in range(400)]
    lines.append(lines[0])
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, 7.0, day) for i in range(100)], "o_orderkey long, o_totalprice double, o_orderdate timestamp") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    out = catalog.copy_normalised_rate(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    parts = [int(n) for n in re.findall(r"hashpartitioning\(yr#\d+, l_orderkey#\d+L, (\d+)\)", plan)]
    assert parts and min(parts) >= len(lines) / 50
    (r,) = out.collect()
    assert (r.yr, r.qty, r.n_orders, r.order_total, r.n_placed) == (2024, 802, 100, 700, 100)
    assert (r.per_copy, r.era_total) == (5.0, 10.0)
