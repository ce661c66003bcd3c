"""Statements on the catalog's tables, and their change semantics."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from marketloom.sources import catalog


def test_catalog_statements(spark, tmp_path):
    c = catalog.Catalog(spark, "statements", str(tmp_path / "db"))
    c.create()
    c.create("indicators")
    assert c.tables() == sorted(catalog.TABLES)
    assert c.properties("open_positions_latest")["primary.key"] == "account_id, symbol" and c.properties("orders_history")["change.mode"] == "append"
    found = {r.column_name: (r.data_type, r.key_place) for r in c.describe("indicators_latest").collect()}
    assert found == {"symbol": ("string", 1), "indicator_name": ("string", 2), "time": ("timestamp", 0), "indicator_value": ("decimal(18,8)", 0)}

    rows = lambda *x: spark.createDataFrame(list(x), "op string, account_id string, symbol string, net_qty double, avg_price double, last_updated long, extra int")
    table = lambda: sorted((r.account_id, r.symbol, r.net_qty) for r in c.read("open_positions_latest").collect())
    c.write("open_positions_latest", rows(("UPSERT", "A", "X", 1.0, 9.0, 1, 0), ("UPSERT", "A", "X", 2.0, 9.0, 2, 0), ("UPSERT", "B", "X", 3.0, 9.0, 1, 0)), ["last_updated"])
    assert table() == [("A", "X", 2.0), ("B", "X", 3.0)]
    c.write("open_positions_latest", rows(("DELETE", "A", "X", None, None, 3, 0), ("UPSERT", "C", "Y", 4.0, None, 3, 0)), ["last_updated"])
    assert table() == [("B", "X", 3.0), ("C", "Y", 4.0)]
    c.delete("open_positions_latest", "avg_price > 5")
    assert table() == [("C", "Y", 4.0)]

    for _ in range(2):
        c.write("risk_alerts_history", spark.createDataFrame([("A", "over")], "account_id string, message string"))
    assert {r.table_name: r.n_rows for r in c.counts("risk_alerts_history", "open_positions_latest", "indicators").collect()} == {"risk_alerts_history": 2, "open_positions_latest": 1, "indicators": 0}
    c.delete("risk_alerts_history")
    assert c.read("risk_alerts_history").count() == 0
    c.drop("risk_alerts_history", "indicators")
    assert "indicators" not in c.tables()
    with pytest.raises(AnalysisException):
        c.read("indicators")
    c.drop()
    assert "statements" not in [d.name for d in spark.catalog.listDatabases()]
