"""The tables of the market data and trading catalog, and the statements on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom.sources.io import latest

_BAR = "symbol string, time timestamp, open decimal(10,4), high decimal(10,4), low decimal(10,4), close decimal(10,4), volume bigint"
_KEY = "account_id string, strategy_id string, symbol string"
#: Name to (H for history or L for latest, primary key, columns).
TABLES = {
    "market_data_history": ("H", "", _BAR),
    "indicators": ("L", "symbol, time", "symbol string, time timestamp, sma5 double, sma14 double, sma21 double, ema5 double, ema14 double, ema21 double, rsi14 double"),
    "strategy_signals": ("H", "", "run_id string, symbol string, time timestamp, close decimal(10,4), sma5 decimal(18,8), sma21 decimal(18,8), signal string, signal_strength decimal(5,2)"),
    "indicators_latest": ("L", "symbol, indicator_name", "symbol string, indicator_name string, time timestamp, indicator_value decimal(18,8)"),
    "indicators_timeseries": ("L", "run_id, symbol, time, indicator_name", "run_id string, symbol string, time timestamp, indicator_name string, indicator_value decimal(18,8)"),
    "orders_history": ("H", "", f"order_id string, {_KEY}, side string, qty double, price double, status string, ts timestamp"),
    "order_events_history": ("H", "", "order_id string, event_type string, event_data string, ts timestamp"),
    "exec_report_history": ("H", "", f"{_KEY}, order_id string, fill_id string, side string, fill_qty double, fill_price double, ts timestamp"),
    "trade_signal_history": ("H", "", f"signal_id string, {_KEY}, action string, qty double, price double, ts timestamp"),
    "trade_match_history": ("H", "", f"match_id string, {_KEY}, buy_order_id string, sell_order_id string, buy_ts bigint, sell_ts bigint, buy_price double, sell_price double, matched_qty double, realized_pnl double, match_ts bigint"),
    "position_close_history": ("H", "", f"{_KEY}, total_qty double, avg_price double, open_ts bigint, close_ts bigint, realized_pnl double"),
    "realized_pnl_latest": ("L", "account_id, strategy_id, symbol", f"{_KEY}, realized_pnl double, ts bigint"),
    "unrealized_pnl_latest": ("L", "account_id, strategy_id, symbol", f"{_KEY}, unrealized_pnl double, current_price double, avg_price double, net_qty double, ts bigint"),
    "open_positions_lots": ("L", "account_id, strategy_id, symbol, lot_id", f"{_KEY}, lot_id string, side string, qty_open double, qty_rem double, avg_price double, ts_open bigint, ts_updated bigint"),
    "open_positions_rollup": ("L", "account_id, strategy_id, symbol", f"{_KEY}, side string, net_qty double, avg_price double, last_updated bigint"),
    "open_positions_latest": ("L", "account_id, symbol", "account_id string, symbol string, net_qty double, avg_price double, last_updated bigint"),
    "portfolio_latest": ("L", "account_id", "account_id string, equity double, cash_balance double, exposure double, margin_used double, ts bigint"),
    "risk_limits_latest": ("L", "account_id, strategy_id", "account_id string, strategy_id string, max_open_symbols int, max_notional double, blocked boolean, ts timestamp"),
    "risk_state_latest": ("L", "account_id, strategy_id", "account_id string, strategy_id string, open_symbols int, gross_notional double, breached boolean, ts timestamp"),
    "risk_alerts_history": ("H", "", "account_id string, message string, ts timestamp"),
    "trendsummary10": ("H", "", "symbol string, ts bigint, alpha double, confidence double, phase string, direction string, breakout_direction string, last_breakout_ts bigint, breakout_recency double, breakout_strength double, lines_used int"),
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Rows as rows of a catalog table: its columns by name, in its types; those that df lacks are null."""
    have = set(df.columns)
    fields = StructType.fromDDL(TABLES[name][2]).fields
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def append(df: DataFrame, name: str, path: str) -> None:
    """Maps rows to a catalog table and appends them to its files."""
    conform(df, name).write.mode("append").parquet(path)


class Catalog:
    """The tables as a database of the session's catalog: statements, and writes by each table's change semantics.

    A table's properties say how it changes: append (a history) or upsert by its primary key, where the latest row of a key stays.
    """

    def __init__(self, spark: SparkSession, database: str = "marketloom", location: str | None = None):
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))

    def create(self, *names: str) -> None:
        """CREATE TABLE IF NOT EXISTS, of all tables if none is named."""
        for name in names or TABLES:
            self._create(name, name)

    def _create(self, name: str, like: str) -> None:
        kind, key, columns = TABLES[like]
        mode = "append" if kind == "H" else "upsert"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.database}.{name} ({columns}) USING parquet TBLPROPERTIES ('change.mode' = '{mode}', 'primary.key' = '{key}')")

    def tables(self) -> list[str]:
        """SHOW TABLES."""
        return sorted(r.tableName for r in self.spark.sql(f"SHOW TABLES IN {self.database}").collect() if not r.isTemporary)

    def properties(self, name: str) -> dict[str, str]:
        """SHOW TBLPROPERTIES."""
        return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.database}.{name}").collect()}

    def describe(self, name: str) -> DataFrame:
        """DESCRIBE TABLE, with the place of each column in the primary key (from 1; 0 outside it)."""
        key = [c for c in self.properties(name)["primary.key"].split(", ") if c]
        place = F.coalesce(*[F.when(F.col("col_name") == c, i) for i, c in enumerate(key, 1)], F.lit(0)).cast("int")
        return self.spark.sql(f"DESCRIBE TABLE {self.database}.{name}").select(F.lit(name).alias("table_name"), F.col("col_name").alias("column_name"), "data_type", place.alias("key_place"))

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    def write(self, name: str, rows: DataFrame, order: list[str] | None = None) -> None:
        """Appends rows to a history. Of a table with a primary key the rows of the keys given are replaced by the last of them in this
        order; rows whose column op is DELETE take their key away."""
        full, properties = f"{self.database}.{name}", self.properties(name)
        if properties["change.mode"] == "append":
            conform(rows, name).write.insertInto(full)
            return
        key = properties["primary.key"].split(", ")
        last = latest(rows, key, order or [c for c in rows.columns if c not in key]).drop("op")
        kept = self.read(name).join(rows.select(*key).distinct(), key, "left_anti")
        self._replace(name, kept.unionByName(conform(last, name)))

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Rows that rest on the table itself are written once, as a table beside it that then takes its name."""
        aside = f"{name}__next"
        self.drop(aside)
        self._create(aside, name)
        rows.write.insertInto(f"{self.database}.{aside}")
        self.drop(name)
        self.spark.sql(f"ALTER TABLE {self.database}.{aside} RENAME TO {self.database}.{name}")

    def delete(self, name: str, condition: str | None = None) -> None:
        """DELETE FROM: all rows, or those for which the condition is true."""
        if condition is None:
            self.spark.sql(f"TRUNCATE TABLE {self.database}.{name}")
        else:
            self._replace(name, self.read(name).where(f"NOT coalesce({condition}, false)"))

    def drop(self, *names: str) -> None:
        """DROP TABLE, or the database with all its tables if none is named."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{name}")
        if not names:
            self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")

    def counts(self, *names: str) -> DataFrame:
        """table_name and n_rows, of all tables if none is named."""
        each = [self.read(n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows")).select("table_name", "n_rows") for n in names or self.tables()]
        return reduce(DataFrame.unionByName, each)
