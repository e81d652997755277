"""Stand-in panel views over the star-schema test tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.lineage import file_bytes, sized_session

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def _bars(bucket: str, order: str) -> str:
    return f"""
  SELECT *, coalesce(lag(close) OVER (PARTITION BY code_id ORDER BY trade_date), open) AS pre_close FROM (
    SELECT code_id, trade_date, max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
           max(CASE WHEN rn = n THEN px END) AS close, CAST(sum(q) AS DOUBLE) AS volume, CAST(sum(a) AS DOUBLE) AS amount
    FROM (SELECT l_suppkey AS code_id, {bucket} AS trade_date, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS px, l_quantity AS q,
                 CAST(l_extendedprice AS DECIMAL(18,2)) AS a,
                 row_number() OVER (PARTITION BY l_suppkey, {bucket} ORDER BY {order}) AS rn,
                 count(*) OVER (PARTITION BY l_suppkey, {bucket}) AS n
          FROM lineitem) t GROUP BY code_id, trade_date) b"""


VIEWS = {
    "bars_d": _bars("CAST(l_shipdate AS DATE)", "l_orderkey, l_linenumber, l_partkey"),
    "bars_m": _bars("CAST(date_trunc('month', l_shipdate) AS DATE)", "l_shipdate, l_orderkey, l_linenumber, l_partkey"),
    "securities": """
  SELECT s_suppkey AS code_id,
    concat(CASE s_suppkey % 5 WHEN 0 THEN 'sh60' WHEN 1 THEN 'sz00' WHEN 2 THEN 'sz30' WHEN 3 THEN 'sh68' ELSE 'bj83' END, lpad(CAST(s_suppkey AS STRING), 4, '0')) AS code,
    concat(CASE WHEN s_suppkey % 17 = 3 THEN '*ST ' WHEN s_suppkey % 19 = 5 THEN 'ST ' WHEN s_suppkey % 23 = 7 THEN '退 ' ELSE '' END, 'Co', lpad(CAST(s_suppkey AS STRING), 4, '0')) AS name,
    n_regionkey AS industry, floor((1000 + s_acctbal) * 100 + 0.5) / 1 AS float_shares
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "calendar": "SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem",
    "filings": """
  SELECT code_id, report_date, report_date + d AS publish_date, CASE WHEN (code_id + y + q) % 11 = 0 THEN NULL ELSE ytd_f END AS r_revenue, inv AS b_inventory FROM filing_base
  WHERE (code_id + 3 * y + q) % 13 <> 0
  UNION ALL
  SELECT code_id, report_date, report_date + (d + 45), ytd_a, inv FROM filing_base WHERE (code_id + 3 * y + q) % 13 <> 0 AND (code_id + y + q) % 3 = 0""",
    "filing_base": """
  SELECT code_id, y, q, last_day(make_date(y, q * 3, 1)) AS report_date, inv,
         CAST(sum(rev_f) OVER (PARTITION BY code_id, y ORDER BY q) AS DOUBLE) AS ytd_f, CAST(sum(rev_a) OVER (PARTITION BY code_id, y ORDER BY q) AS DOUBLE) AS ytd_a,
         CAST(20 + (code_id * 7 + q * 13) % 90 AS INTEGER) AS d
  FROM (SELECT l_suppkey AS code_id, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(quarter(l_shipdate) AS INTEGER) AS q,
               sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS rev_f,
               sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS rev_a, CAST(sum(l_quantity) AS DOUBLE) AS inv
        FROM lineitem GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate)) g""",
    "hour_bars": """
  SELECT user_id, date_trunc('hour', ts) AS bar_ts, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount,
         max(value) AS high, min(value) AS low FROM events GROUP BY user_id, date_trunc('hour', ts)""",
    "notices": """
  SELECT doc_id % (SELECT count(*) FROM supplier) AS code_id, date '1995-01-02' + CAST(doc_id % 2400 AS INTEGER) AS notice_date, text AS title FROM documents""",
    # a monthly panel with everything that selections and evaluations need
    "panel": """
  SELECT b.*, s.code, s.name, s.industry, b.close * s.float_shares AS mv,
         lead(close, 1) OVER (PARTITION BY b.code_id ORDER BY trade_date) / close - 1 AS next_return,
         close / lag(close, 3) OVER (PARTITION BY b.code_id ORDER BY trade_date) - 1 AS momentum
  FROM bars_m b JOIN securities s ON b.code_id = s.code_id""",
}


def needs(sql: str) -> list[str]:
    """The views that sql names, with those they need, in order."""
    out: list[str] = []

    def add(text: str):
        for v in VIEWS:
            if v not in out and re.search(rf"\b{v}\b", text):
                add(VIEWS[v])
                if v not in out:
                    out.append(v)

    add(sql)
    return out


def with_views(sql: str) -> str:
    """sql for DuckDB, with the definitions of the views it names in front."""
    ctes = [f"{v} AS ({VIEWS[v]})" for v in needs(sql)]
    if not ctes:
        return sql
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Tables:
    """The tables of a folder and the views over them as attributes. Scans are lazy: a view reads the columns it uses.
    Large tables are read in a session whose shuffles have more partitions."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = sized_session(spark, file_bytes(spark, *(f"{sf_dir}/{t}.parquet" for t in TABLES)))
        self.sf_dir, self._held = sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._held.setdefault(name, self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
        if name in VIEWS:
            if name not in self._held:
                sql = VIEWS[name]
                inputs = {t: getattr(self, t) for t in [*TABLES, *VIEWS] if t != name and re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)}
                text = sql.replace("{", "{{").replace("}", "}}")
                for t in inputs:
                    text = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{{{t}}}", text)
                self._held[name] = self.spark.sql(text, **inputs)
            return self._held[name]
        raise AttributeError(name)
