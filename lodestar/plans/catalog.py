"""The registered queries: each one operator of the engine over the driver's tables, beside equivalent SQL.

A query is SQL in which {table} stands for a scan of that table, or a function for what SQL can't say.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.settings import Settings
from lodestar.operators.relational import multiset_difference, top_k
from lodestar.plans import profile
from lodestar.session import shared_folder
from lodestar.sources import footer, hosted
from lodestar.sources.scan import aggregating_scan, cardinality, describe, narrow, scan, sql, with_batch_index, write_table
from lodestar.streaming.windows import tumbling

Q = Callable[[SparkSession, str], DataFrame]


def _sql(text: str) -> Q:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql(spark, re.sub(r"\{(\w+)\}", lambda m: f"read_scan('{sf_dir}/{m[1]}.parquet')", text))

    return run


def _plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet")


#: name: SQL that both engines read, or (Spark's, DuckDB's).
SQL: dict[str, str | tuple[str, str]] = {
    # Scans and projections
    "scan_full": "select * from {nation}",
    "scan_projection": "select l_orderkey, l_quantity, l_shipdate from {lineitem}",
    "scan_projection_reorder": "select l_tax, l_discount, l_orderkey from {lineitem}",
    "scan_duplicate_column": "select l_orderkey as a, l_orderkey as b from {lineitem}",
    "scan_string_only": "select count(c_name) as n, count(distinct c_mktsegment) as d, min(c_name) as lo, max(c_name) as hi from {customer}",
    "scan_fixed_only": (
        "select sum(l_orderkey) as s_key, sum(l_linenumber) as s_line, sum(l_quantity) as s_qty from {lineitem}",
        "select cast(sum(l_orderkey) as bigint) as s_key, cast(sum(l_linenumber) as bigint) as s_line, sum(l_quantity) as s_qty from {lineitem}",
    ),
    "scan_nested": (
        "select vec_id, size(embedding) as n, element_at(embedding, 1) as head from {embeddings}",
        "select vec_id, cast(len(embedding) as int) as n, embedding[1] as head from {embeddings}",
    ),
    "scan_no_column": "select count(*) as n from (select 1 as one from {events})",
    # Filters
    "filter_eq": "select * from {orders} where o_orderkey = 77",
    "filter_not_eq": "select count(*) as n from {orders} where o_orderstatus <> 'F'",
    "filter_range": "select o_orderkey, o_totalprice from {orders} where o_orderkey >= 1000 and o_orderkey < 2000",
    "filter_between": "select l_orderkey, l_linenumber from {lineitem} where l_orderkey between 500 and 600",
    "filter_in": "select o_orderkey, o_custkey from {orders} where o_orderkey in (1, 7, 512, 9999, 100000000)",
    "filter_or": "select o_orderkey from {orders} where o_orderkey < 10 or o_orderkey > 14900",
    "filter_modulo": "select o_orderkey from {orders} where o_orderkey % 1000 = 7",
    "filter_float": "select l_orderkey, l_linenumber, l_discount from {lineitem} where l_discount > 0.05 and l_quantity <= 3",
    "filter_contradiction": "select o_orderkey from {orders} where o_orderkey < 10 and o_orderkey > 20",
    "filter_multi_conjunct": "select l_orderkey, l_linenumber from {lineitem} where l_quantity < 24 and l_discount >= 0.05 and l_returnflag = 'A'",
    "filter_two_columns": "select l_orderkey, l_linenumber from {lineitem} where l_discount < l_tax and l_orderkey > 1000",
    "filter_like_prefix": "select c_custkey, c_name from {customer} where c_name like 'Customer#00000001%'",
    "filter_like_suffix": "select c_custkey, c_name from {customer} where c_name like '%7'",
    "filter_like_underscore": "select o_orderkey, o_orderpriority from {orders} where o_orderpriority like '_-%'",
    "filter_not_like": "select o_orderkey, o_orderpriority from {orders} where o_orderpriority not like '1%'",
    "filter_or_chain": "select p_partkey from {part} where p_brand = 'Brand#11' or p_brand = 'Brand#23' or p_brand = 'Brand#5'",
    "filter_dict_string": "select l_orderkey, l_linenumber from {lineitem} where l_returnflag = 'R' and l_linestatus = 'F'",
    "filter_mixed_string_numeric": "select l_orderkey, l_linenumber from {lineitem} where l_returnflag = 'R' and l_quantity > 45",
    "filter_prune_columns": "select sum(l_quantity) as q from {lineitem} where l_orderkey < 5000",
    "filter_only_count": "select count(*) as n from {lineitem} where l_shipdate is not null and l_quantity > 25",
    "filter_timestamp": (
        "select o_orderkey from {orders} where o_orderdate >= timestamp_ntz'1996-01-01 00:00:00'",
        "select o_orderkey from {orders} where o_orderdate >= timestamp'1996-01-01 00:00:00'",
    ),
    "filter_cast_unwrap": "select n_nationkey, n_name from {nation} where cast(n_nationkey as bigint) < 7",
    # Aggregates
    "agg_count_star": "select count(*) as n from {lineitem}",
    "agg_count_col": "select count(l_orderkey) as n, count(l_returnflag) as m from {lineitem}",
    "agg_sum_one": ("select sum(1) as n from {lineitem}", "select cast(sum(1) as bigint) as n from {lineitem}"),
    "agg_sum_min_max": (
        "select sum(l_orderkey) as s, min(l_orderkey) as lo, max(l_orderkey) as hi, min(l_extendedprice) as plo, max(l_extendedprice) as phi from {lineitem}",
        "select cast(sum(l_orderkey) as bigint) as s, min(l_orderkey) as lo, max(l_orderkey) as hi, min(l_extendedprice) as plo, max(l_extendedprice) as phi from {lineitem}",
    ),
    "agg_decimal_sum": "select cast(sum(cast(l_extendedprice as decimal(12,2))) as double) as s from {lineitem}",
    "agg_string_minmax": "select min(p_name) as lo, max(p_name) as hi, min(p_type) as tlo from {part}",
    "agg_count_distinct": "select count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts from {lineitem}",
    "agg_filter_clause": "select count(*) filter (where l_quantity > 30) as n, count(*) filter (where l_returnflag = 'N') as r, count(*) as a from {lineitem}",
    "agg_group_expr": (
        "select cast(l_orderkey div 1000 as bigint) as k, count(*) as n from {lineitem} group by l_orderkey div 1000",
        "select cast(l_orderkey // 1000 as bigint) as k, count(*) as n from {lineitem} group by l_orderkey // 1000",
    ),
    "agg_group_string": "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as q from {lineitem} group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus",
    # Order and limit
    "topk_asc": "select o_orderkey, o_totalprice from {orders} order by o_totalprice, o_orderkey limit 20",
    "topk_desc": "select o_orderkey, o_custkey from {orders} order by o_orderkey desc limit 25",
    "limit_subquery_count": "select count(*) as n from (select l_orderkey from {lineitem} limit 5000) as t",
    # Joins and sets
    "join_using": "select o_orderstatus, count(*) as n from {orders} join (select l_orderkey as o_orderkey, l_quantity from {lineitem}) as l using (o_orderkey) group by o_orderstatus",
    "join_on": "select c.c_mktsegment, count(*) as n from {orders} as o join {customer} as c on o.o_custkey = c.c_custkey group by c.c_mktsegment",
    "join_self": "select count(*) as n from {orders} as a join {orders} as b on a.o_orderkey = b.o_custkey",
    "join_dynamic_filter": "select count(*) as n, sum(l.l_quantity) as q from {lineitem} as l join {orders} as o on l.l_orderkey = o.o_orderkey where o.o_totalprice > 400000 and o.o_orderpriority = '1-URGENT'",
    "except_all_filtered": "select o_orderkey, o_orderstatus from {orders} except all select o_orderkey, o_orderstatus from {orders} where o_orderstatus = 'F'",
    "scalar_subquery": "select (select count(*) from {orders}) as o, (select count(*) from {lineitem}) as l, (select max(o_orderkey) from {orders}) - (select min(o_orderkey) from {orders}) as d",
    "derived_table": "select k, n from (select o_custkey as k, count(*) as n from {orders} group by o_custkey) as t where n > 15",
    "exists_subquery": "select c_custkey from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey and o_orderstatus = 'F' and o_totalprice > 250000)",
    # Expressions
    "expr_casts": "select o_orderkey, cast(o_orderkey as int) as i, cast(o_orderkey as varchar(20)) as s, cast(o_custkey as double) as d, cast(cast(o_totalprice as decimal(38,2)) as double) as m from {orders}",
    "expr_arith": (
        "select o_orderkey, o_orderkey + 3 as a, o_orderkey * 2 as m, cast(o_orderkey % 7 as bigint) as r, cast((o_orderkey - 100) div 7 as bigint) as d from {orders}",
        "select o_orderkey, o_orderkey + 3 as a, o_orderkey * 2 as m, cast(o_orderkey % 7 as bigint) as r, cast((o_orderkey - 100) // 7 as bigint) as d from {orders}",
    ),
    "expr_concat": ("select n_nationkey, 'n' || cast(n_nationkey as string) || ':' || n_name as s from {nation}", "select n_nationkey, 'n' || n_nationkey || ':' || n_name as s from {nation}"),
    "expr_list_index": (
        "select n_nationkey, element_at(array('alpha', 'beta', 'gamma', 'delta'), cast(n_nationkey % 4 + 1 as int)) as g from {nation}",
        "select n_nationkey, (['alpha', 'beta', 'gamma', 'delta'])[n_nationkey % 4 + 1] as g from {nation}",
    ),
    "expr_is_null": "select count(*) as n, count(*) filter (where c_name is null) = 0 as complete from {customer}",
    "range_source": ("select id as i, 'str' || cast(id as string) as s from range(0, 20000)", "select range as i, 'str' || range as s from range(0, 20000)"),
    # What the host engine gives, not the scan
    "host_left_join": "select c_custkey, count(o_orderkey) as n from {customer} left join {orders} on c_custkey = o_custkey group by c_custkey",
    "host_semi_join": (
        "select c_custkey, c_name from {customer} left semi join {orders} on c_custkey = o_custkey",
        "select c_custkey, c_name from {customer} where c_custkey in (select o_custkey from {orders})",
    ),
    "host_anti_join": (
        "select c_custkey, c_name from {customer} left anti join {orders} on c_custkey = o_custkey and o_orderpriority = '1-URGENT'",
        "select c_custkey, c_name from {customer} where c_custkey not in (select o_custkey from {orders} where o_orderpriority = '1-URGENT')",
    ),
    "host_union_all": "select n_name as name from {nation} union all select r_name from {region}",
    "host_intersect_all": "select o_custkey from {orders} intersect all select c_custkey from {customer} where c_custkey % 3 = 0",
    "host_window_rank": (
        "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from {orders}",
        "select o_orderkey, o_custkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as int) as r from {orders}",
    ),
    "host_rollup": "select l_returnflag, l_linestatus, count(*) as n from {lineitem} group by rollup (l_returnflag, l_linestatus)",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "lineitem")
        .where("l_shipdate >= timestamp_ntz'1994-01-01 00:00:00' and l_shipdate < timestamp_ntz'1996-01-01 00:00:00' and l_quantity < 24")
        .selectExpr("cast(sum(cast(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2)) as decimal(38,4))) as double) as revenue")
    )


def scan_strict_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/orders.parquet", strict=True).select("o_orderkey", "o_orderstatus")


def describe_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(_table(spark, sf_dir, "orders"))


def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return multiset_difference(orders, orders.where("o_orderstatus = 'O'"))


def topk_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 30, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


def _now(df: DataFrame) -> DataFrame:
    """A few rows, computed while the settings of the moment hold."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def cast_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Settings(spark).held({"cast_pushdown": True}):
        return narrow(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey", "int").select("l_orderkey", "l_linenumber")


def cast_narrow_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Settings(spark).held({"cast_pushdown": True}):
        lines = narrow(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey", "int")
    joined = lines.join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def narrow_transfer_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Settings(spark).held({"narrow_transfer": True}):
        return _now(_table(spark, sf_dir, "lineitem").agg(F.sum("l_orderkey").alias("s"), F.count("*").alias("n")))


def settings_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same count under each value of each setting."""
    tried: list[dict[str, object]] = [{}, {"prefetch_depth": 0}, {"prefetch_depth": 8}, {"scheduler_queue_depth": 1}, {"scheduler_num_streams": 1}, {"enable_yield": False}, {"narrow_transfer": True}]
    out = None
    for values in tried:
        name = ",".join(f"{k}={str(v).lower()}" for k, v in values.items()) or "default"
        with Settings(spark).held(values):
            orders = _table(spark, sf_dir, "orders").where("o_orderkey >= 4096")
            one = _now(orders.agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))).select(F.lit(name).alias("setting"), "n", "s")
        out = one if out is None else out.unionByName(one)
    return out


def roundtrip_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/copy-{uuid.uuid4().hex}"
    write_table(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, "snappy", rows_per_group=8192)
    # A copy of no rows has no row group, which strict mode refuses.
    return scan(spark, path, strict=cardinality(spark, path) > 0).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


def rowgroup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = footer.rowgroup_stats(spark, f"{sf_dir}/orders.parquet")
    return stats.where("column in ('o_orderkey', 'o_custkey')").groupBy("column").agg(F.sum("num_rows").alias("n_rows"), F.min(F.col("min_value").cast("long")).alias("lo"), F.max(F.col("max_value").cast("long")).alias("hi"))


def footer_agg_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footer.footer_agg(spark, f"{sf_dir}/orders.parquet", "o_orderkey")


def footer_agg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footer.footer_agg(spark, f"{sf_dir}/orders.parquet", "o_orderkey", low=100, high=5000)


def footer_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, cardinality(spark, f"{sf_dir}/{t}.parquet")) for t in ("customer", "orders", "lineitem")], "name string, n long")


def footer_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, bounds and a proven cast over a table in folders by one of its columns."""
    path = f"{shared_folder(spark)}/partitioned-{uuid.uuid4().hex}"
    _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition(3).write.partitionBy("o_orderstatus").parquet(path)
    bounds = footer.footer_agg(spark, path, "o_custkey", low=10, high=1000)
    with Settings(spark).held({"cast_pushdown": True}):
        cast = narrow(spark, path, "o_orderkey", "int").agg(F.sum("o_orderkey").alias("keys"))
    return bounds.crossJoin(cast).withColumn("n_all", F.lit(cardinality(spark, path)).cast("long"))


def agg_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregating_scan(spark, f"{sf_dir}/lineitem.parquet").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


def scan_batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_batch_index(_table(spark, sf_dir, "orders")).agg(F.count("*").alias("n"), F.min("batch_row").alias("first"), F.max("batch_row").alias("last"))


def hosted_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosted.catalog(spark, [f"{sf_dir}/{t}.parquet" for t in ("nation", "region", "supplier")]).select("name", "offset", "size")


def hosted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Settings(spark).held({"hosted_root": sf_dir}):
        return scan(spark, "hosted://supplier.parquet").select("s_suppkey", "s_name")


def scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.scan_metrics(_table(spark, sf_dir, "lineitem").where("l_quantity < 10").select("l_orderkey"))


def scan_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile.run_measured(_table(spark, sf_dir, "lineitem").where("l_quantity < 10").select("l_orderkey"))
    return sql(spark, "select * from scan_profile()")


def host_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = tumbling(_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return hours.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.col("total").cast("double"))


FUNCTIONS: dict[str, tuple[Q, str | None]] = {
    "flagship": (
        flagship,
        "select cast(sum(cast(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2)) as decimal(38,4))) as double) as revenue from lineitem where l_shipdate >= timestamp'1994-01-01 00:00:00' and l_shipdate < timestamp'1996-01-01 00:00:00' and l_quantity < 24",
    ),
    "scan_strict_ok": (scan_strict_ok, "select o_orderkey, o_orderstatus from orders"),
    "describe_schema": (
        describe_schema,
        "select * from (values ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) as t(column_name, column_type)",
    ),
    "except_all": (except_all, "select o_custkey, o_orderstatus from orders except all select o_custkey, o_orderstatus from orders where o_orderstatus = 'O'"),
    "topk_api": (topk_api, "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 30"),
    "cast_narrow": (cast_narrow, "select cast(l_orderkey as int) as l_orderkey, l_linenumber from lineitem"),
    "cast_narrow_join": (cast_narrow_join, "select o_orderstatus, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by o_orderstatus"),
    "narrow_transfer_invariant": (narrow_transfer_invariant, "select cast(sum(l_orderkey) as bigint) as s, count(*) as n from lineitem"),
    "settings_invariance": (
        settings_invariance,
        "select setting, n, s from (values ('default'), ('prefetch_depth=0'), ('prefetch_depth=8'), ('scheduler_queue_depth=1'), ('scheduler_num_streams=1'), ('enable_yield=false'), ('narrow_transfer=true')) as t(setting), (select count(*) as n, cast(sum(o_custkey) as bigint) as s from orders where o_orderkey >= 4096) as r",
    ),
    "roundtrip_copy": (roundtrip_copy, "select o_orderstatus, count(*) as n, cast(sum(o_orderkey) as bigint) as s from orders group by o_orderstatus"),
    "rowgroup_stats": (
        rowgroup_stats,
        'select \'o_orderkey\' as "column", count(*) as n_rows, min(o_orderkey) as lo, max(o_orderkey) as hi from orders union all select \'o_custkey\', count(*), min(o_custkey), max(o_custkey) from orders',
    ),
    "footer_agg_minmax": (footer_agg_minmax, "select count(o_orderkey) as n_rows, min(o_orderkey) as min_value, max(o_orderkey) as max_value from orders"),
    "footer_agg_filtered": (footer_agg_filtered, "select count(o_orderkey) as n_rows, min(o_orderkey) as min_value, max(o_orderkey) as max_value from orders where o_orderkey between 100 and 5000"),
    "footer_cardinality": (
        footer_cardinality,
        "select 'customer' as name, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem",
    ),
    "footer_partitioned": (
        footer_partitioned,
        "select count(*) filter (where o_custkey between 10 and 1000) as n_rows, min(o_custkey) filter (where o_custkey between 10 and 1000) as min_value, max(o_custkey) filter (where o_custkey between 10 and 1000) as max_value, cast(sum(o_orderkey) as bigint) as keys, count(*) as n_all from orders",
    ),
    "agg_pushdown": (agg_pushdown, "select count(*) as n, min(l_orderkey) as lo, max(l_orderkey) as hi from lineitem"),
    "scan_batch_index": (scan_batch_index, 'select count(*) as n, cast(0 as bigint) as "first", count(*) - 1 as "last" from orders'),
    "hosted_catalog": (hosted_catalog, None),
    "hosted_scan": (hosted_scan, "select s_suppkey, s_name from supplier"),
    "scan_metrics": (scan_metrics, None),
    "scan_profile": (scan_profile, None),
    "host_tumbling": (
        host_tumbling,
        "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, cast(sum(cast(value as decimal(12,2))) as double) as total from events group by 1, 2",
    ),
}


def queries() -> dict[str, Q]:
    return {name: _sql(text if isinstance(text, str) else text[0]) for name, text in SQL.items()} | {name: run for name, (run, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _plain(text if isinstance(text, str) else text[1]) for name, text in SQL.items()} | {name: text for name, (_, text) in FUNCTIONS.items() if text}
