"""SQL text over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelode.sources.tables import NAMES, table

# Texts that show what passes through. Each works on the same tables in any SQL engine.
TEXTS = {
    "filter": ("select question_id, difficulty from questions where difficulty = :difficulty", {"difficulty": 3}),
    "join": ("""select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by n_name""", {}),
    "rollup": ("""select l_returnflag, l_linestatus, count(*) as items, sum(cast(l_quantity as bigint)) as quantity
from lineitem group by rollup(l_returnflag, l_linestatus)""", {}),
    "except": ("""select c_custkey from customer except select o_custkey as c_custkey from orders
where o_orderstatus = :status""", {"status": "F"}),
    "window": ("""select o_orderpriority, o_orderkey, o_totalprice, place from (
select o_orderpriority, o_orderkey, o_totalprice,
  row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as place from orders) r
where place <= 10""", {}),
}


def register_tables(spark: SparkSession, folder: str, text: str) -> None:
    """The given tables that the text names, as temporary views."""
    for name in NAMES:
        if name not in text:
            continue
        table(spark, folder, name).createOrReplaceTempView(name)


def sql_query(spark: SparkSession, text: str, args: dict | None = None, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """(I) A query text with named arguments over registered views."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})


def rows_affected(result: DataFrame) -> DataFrame:
    """(I) Number of rows a query returned."""
    return result.agg(F.count("*").alias("rows_affected"))
