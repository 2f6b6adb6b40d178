"""One registered query per operator over the driver's tables, beside the DuckDB SQL that gives the same rows.

The tables hold no nulls, so queries that need missing values make them by an expression that the SQL repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as aggregating
from ..operators import assessment, filters, gold, identifiers, identity, intervals, joins, ontology, profile, provenance, relationships
from ..sources import files
from ..types import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> Table:
    """Orders with missing priorities where they are low, and the order key as the row locator."""
    df = read(spark, sf, "orders").withColumn("priority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))).withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return Table("orders", df, None, {"o_totalprice": 4, "price": 4})


def lineitem(spark: SparkSession, sf: str) -> Table:
    df = read(spark, sf, "lineitem").withColumn("qty", F.when(F.col("l_quantity") >= 5, F.col("l_quantity")))
    return Table("lineitem", df, None, {"l_quantity": 4, "l_extendedprice": 4, "qty": 4, "l_discount": 4, "l_tax": 4})


def customer(spark: SparkSession, sf: str) -> Table:
    df = read(spark, sf, "customer").withColumn("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return Table("customer", df, "c_custkey", {"c_acctbal": 4})


def events(spark: SparkSession, sf: str) -> Table:
    df = read(spark, sf, "events").withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type"))).withColumn("worth", F.when(F.col("event_type") != "view", F.col("value")))
    return Table("events", df, "event_id", {"value": 6, "worth": 6})


CUSTOMER_SQL = "(select *, case when c_mktsegment <> 'BUILDING' then c_mktsegment end as segment from customer)"
ORDERS_SQL = "(select *, case when o_orderpriority <> '5-LOW' then o_orderpriority end as priority, case when o_orderstatus <> 'P' then o_totalprice end as price from orders)"
LINE_SQL = "(select *, case when l_quantity >= 5 then l_quantity end as qty from lineitem)"
EVENTS_SQL = "(select *, case when event_type <> 'error' then event_type end as kind, case when event_type <> 'view' then value end as worth from events)"


# Filters: all rows that match, not a page.
def _filter(name: str, rule: dict, where: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return filters.filtered(customer(spark, sf), [rule]).select("c_custkey", "segment", "c_acctbal")

    run.__name__ = f"filter_{name}"
    query(f"select c_custkey, segment, c_acctbal from {CUSTOMER_SQL} where {where}")(run)


_filter("eq", {"column": "segment", "op": "eq", "value": "MACHINERY"}, "segment = 'MACHINERY'")
_filter("eq_null", {"column": "segment", "op": "eq", "value": None}, "segment is null")
_filter("eq_other_kind", {"column": "segment", "op": "eq", "value": 7}, "false")
_filter("ne", {"column": "segment", "op": "ne", "value": "MACHINERY"}, "segment is distinct from 'MACHINERY'")
_filter("in", {"column": "segment", "op": "in", "value": ["MACHINERY", "AUTOMOBILE"]}, "segment in ('MACHINERY', 'AUTOMOBILE')")
_filter("in_null", {"column": "segment", "op": "in", "value": ["MACHINERY", None]}, "segment = 'MACHINERY' or segment is null")
_filter("not_in", {"column": "segment", "op": "not_in", "value": ["MACHINERY", "AUTOMOBILE"]}, "segment is null or segment not in ('MACHINERY', 'AUTOMOBILE')")
_filter("lt", {"column": "c_acctbal", "op": "lt", "value": 100.0}, "c_acctbal < 100")
_filter("lte", {"column": "c_custkey", "op": "lte", "value": 100}, "c_custkey <= 100")
_filter("gt", {"column": "c_acctbal", "op": "gt", "value": 5000.5}, "c_acctbal > 5000.5")
_filter("gte", {"column": "segment", "op": "gte", "value": "HOUSEHOLD"}, "segment >= 'HOUSEHOLD'")
_filter("contains", {"column": "segment", "op": "contains", "value": "CH"}, "contains(segment, 'CH')")
_filter("is_missing", {"column": "segment", "op": "is_missing"}, "segment is null")
_filter("is_not_missing", {"column": "segment", "op": "is_not_missing"}, "segment is not null")


@query(f"select c_custkey, segment from {CUSTOMER_SQL} where c_acctbal >= 0 and segment is distinct from 'FURNITURE' and c_nationkey in (1, 2, 3)")
def filter_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    rules = [{"column": "c_acctbal", "op": "gte", "value": 0}, {"column": "segment", "op": "ne", "value": "FURNITURE"}, {"column": "c_nationkey", "op": "in", "value": [1, 2, 3]}]
    return filters.filtered(customer(spark, sf), rules).select("c_custkey", "segment")


@query("select c_custkey, c_name from customer order by c_custkey limit 50 offset 20")
def read_page(spark: SparkSession, sf: str) -> DataFrame:
    return filters.read_rows(customer(spark, sf), ["c_name"], 20, 50)


@query(f"select c_custkey, c_name from {CUSTOMER_SQL} where segment is null order by c_custkey limit 30")
def filter_page(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_rows(customer(spark, sf), [{"column": "segment", "op": "is_missing"}], ["c_name"], 30)


# Metrics, each alone and per group.
_D = "cast({c} as decimal(38,4))"
METRIC_SQL = {
    "count": "count(*)", "n_present": "count(price)", "n_missing": "count(*) filter (price is null)", "n_distinct": "count(distinct price)", "sum": "cast(sum(cast(price as decimal(38,4))) as double)",
    "mean": "cast(sum(cast(price as decimal(38,4))) as double) / count(price)", "min": "min(price)", "max": "max(price)", "median": "median(price)", "sd": "stddev_samp(price)", "sem": "stddev_samp(price) / sqrt(count(price))",
}


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`").cast("double"), places) for n in names})


def _metric(op: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spec = {"op": op, "name": "m"} | ({} if op == "count" else {"column": "price"})
        return _rounded(aggregating.aggregate(orders(spark, sf), [spec], ["priority"], reasons=False), "m", places=4)

    run.__name__ = f"agg_{op}"
    query(f"select priority, round(cast({METRIC_SQL[op]} as double), 4) as m from {ORDERS_SQL} group by priority")(run)


for _op in METRIC_SQL:
    _metric(_op)


@query("""select l_linenumber, l_quantity as q, count(*) as n, case when count(x) < 2 then null else round(stddev_samp(x), 6) end as sd,
  case when count(x) = 0 then 'no non-missing values' when count(x) < 2 then 'sd is undefined for fewer than 2 non-missing values (n=' || count(x) || ')' end as reason
  from (select *, case when l_discount > 0.08 then l_tax end as x from lineitem) group by l_linenumber, l_quantity""")
def agg_null_reason(spark: SparkSession, sf: str) -> DataFrame:
    t = Table("lineitem", read(spark, sf, "lineitem").withColumn("x", F.when(F.col("l_discount") > 0.08, F.col("l_tax"))))
    out = aggregating.aggregate(t, [{"op": "count", "name": "n"}, {"op": "sd", "column": "x", "name": "sd"}], ["l_linenumber", "l_quantity"])
    return _rounded(out.withColumnRenamed("sd:reason", "reason").withColumnRenamed("l_quantity", "q"), "sd")


@query(f"select count(*) as n, count(distinct priority) as kinds, round(cast(sum(cast(price as decimal(38,4))) as double), 2) as total from {ORDERS_SQL} where o_orderstatus = 'O'")
def agg_global(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregating.aggregate(orders(spark, sf), [{"op": "count", "name": "n"}, {"op": "n_distinct", "column": "priority", "name": "kinds"}, {"op": "sum", "column": "price", "name": "total"}], filters=[{"column": "o_orderstatus", "op": "eq", "value": "O"}], reasons=False)
    return _rounded(out, "total", places=2)


@query("select count(*) as n, cast(null as double) as total, 'no non-missing values' as reason from orders where false")
def agg_global_empty(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregating.aggregate(orders(spark, sf), [{"op": "count", "name": "n"}, {"op": "sum", "column": "price", "name": "total"}], filters=[{"column": "o_orderkey", "op": "lt", "value": 0}])
    return out.withColumnRenamed("total:reason", "reason")


@query("""select k, n, cast(row_number() over (order by coalesce('int:' || k, 'NoneType:None')) as bigint) as place
  from (select case when l_linenumber <> 3 then l_linenumber end as k, count(*) as n from lineitem group by 1)""")
def agg_group_order(spark: SparkSession, sf: str) -> DataFrame:
    t = Table("lineitem", read(spark, sf, "lineitem").withColumn("k", F.when(F.col("l_linenumber") != 3, F.col("l_linenumber"))))
    groups = aggregating.aggregate(t, [{"op": "count", "name": "n"}], ["k"])
    return aggregating.placed(groups, [aggregating.sort_text(t, "k")])


@query("""select p, count(*) as n from (select case when o_orderpriority = '5-LOW' then null when o_orderpriority = '3-MEDIUM' then null else o_orderpriority end as p from orders) group by p""")
def agg_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    from ..types import normalised

    raw = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(" NA ")).when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("  ")).otherwise(F.col("o_orderpriority"))
    t = Table("orders", read(spark, sf, "orders").withColumn("p", normalised(raw, "string")))
    return aggregating.aggregate(t, [{"op": "count", "name": "n"}], ["p"])


# Units of analysis.
@query("""with u as (select l_orderkey, o_orderpriority, cast(sum(cast(l_quantity as decimal(38,4))) as double) as q, count(*) as n_rows from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)
select o_orderpriority as priority, count(*) as n_units, cast(sum(n_rows) as bigint) as n_rows, round(avg(q), 6) as mean_quantity, round(stddev_samp(q), 6) as sd_quantity, round(stddev_samp(q) / sqrt(count(q)), 6) as sem_quantity from u group by 1""")
def unit_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: per-order quantity totals, summarised by the order's priority."""
    metrics = [{"op": "mean", "column": "quantity", "name": "mean_quantity"}, {"op": "sd", "column": "quantity", "name": "sd_quantity"}, {"op": "sem", "column": "quantity", "name": "sem_quantity"}]
    got = joins.aggregate_join(
        lineitem(spark, sf), Table("orders", read(spark, sf, "orders")), ["l_orderkey"], ["o_orderkey"], metrics, group_by=["right.o_orderpriority"], unit=["left.l_orderkey"],
        unit_metrics=[{"op": "sum", "column": "left.l_quantity", "name": "quantity"}], reasons=False,
    )
    out = got.groups.withColumnRenamed("right.o_orderpriority", "priority").select("priority", "n_units", "n_rows", "mean_quantity", "sd_quantity", "sem_quantity")
    return _rounded(out, "mean_quantity", "sd_quantity", "sem_quantity")


def _by_user(spark: SparkSession, sf: str, policy: str = "exclude", **more: object) -> aggregating.UnitResult:
    t = events(spark, sf)
    df = t.df.withColumn("user", F.when(F.col("user_id") % 10 != 0, F.col("user_id"))).withColumn("band", F.when(F.col("user_id") % 7 == 0, F.col("event_id") % 2).otherwise(F.col("user_id") % 3))
    return aggregating.aggregate_units(Table("events", df, "event_id", {"worth": 6}), [{"op": "count", "name": "n"}, {"op": "mean", "column": "total", "name": "mean_total"}], ["user"], [{"op": "sum", "column": "worth", "name": "total"}], ["band"], on_inconsistent_unit=policy, reasons=False, **more)


BAND_SQL = f"(select *, case when user_id % 10 <> 0 then user_id end as usr, case when user_id % 7 = 0 then event_id % 2 else user_id % 3 end as band from {EVENTS_SQL})"
UNIT_SQL = f"""with r as (select * from {BAND_SQL} where usr is not null), bad as (select usr from r group by usr having count(distinct band) > 1),
u as (select usr, min(band) as band, count(*) as n_rows, cast(sum(cast(worth as decimal(38,6))) as double) as total, count(*) filter (worth is null) as miss from r where usr not in (select usr from bad) group by usr)"""


@query(UNIT_SQL + " select band, count(*) as n_units, cast(sum(n_rows) as bigint) as n_rows, count(*) as n, round(avg(total), 4) as mean_total, count(*) filter (total is null) as units_null, count(*) filter (miss > 0 and miss < n_rows) as units_partial from u group by band")
def unit_exclude(spark: SparkSession, sf: str) -> DataFrame:
    out = _by_user(spark, sf).groups.withColumnRenamed("total:units_null", "units_null").withColumnRenamed("total:units_partial", "units_partial")
    return _rounded(out, "mean_total", places=4)


@query("select cast(0 as bigint) as band, cast(0 as bigint) as n_units where false")
def unit_refuse(spark: SparkSession, sf: str) -> DataFrame:
    return _by_user(spark, sf, "refuse").groups.select("band", "n_units")


@query(f"select count(*) as n, cast(min(event_id) as bigint) as first_row from {BAND_SQL} where usr is null")
def unit_missing_key(spark: SparkSession, sf: str) -> DataFrame:
    return _by_user(spark, sf).missing.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_row"))


@query(f"with r as (select * from {BAND_SQL} where usr is not null) select usr as \"user\", band, count(*) as n_rows from r where usr in (select usr from r group by usr having count(distinct band) > 1) group by 1, 2")
def unit_inconsistent(spark: SparkSession, sf: str) -> DataFrame:
    return _by_user(spark, sf).inconsistent


@query(UNIT_SQL + " select case when miss = 0 then 'complete' when miss = n_rows then 'all_missing' else 'partial' end as state, count(*) as n from u group by 1")
def unit_missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _by_user(spark, sf).units.groupBy(F.col("total:rows").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select *, row_number() over (partition by user_id order by event_id) as k from events), u as (select user_id, event_type, count(*) as n_rows from events group by 1, 2)
select user_id, count(*) as n_rows, string_agg(case when k <= 20 then cast(event_id as varchar) end, ',' order by event_id) as source_rows,
  (select string_agg(t, ',' order by t) from (select distinct event_type as t from events e where e.user_id = r.user_id)) as kinds from r group by user_id order by user_id limit 50""")
def unit_audit(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregating.unit_audit(Table("events", read(spark, sf, "events"), "event_id"), ["user_id"], [], 50, ["event_type"])
    return out.withColumnRenamed("event_type:values", "kinds")


# Provenance.
@query(f"""with a as (select event_id, event_id - row_number() over (order by event_id) as g from {EVENTS_SQL} where kind = 'click')
select cast(min(event_id) as bigint) as first, cast(max(event_id) as bigint) as last from a group by g""")
def provenance_ranges(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf)
    return provenance.ranges(filters.filtered(t, [{"column": "kind", "op": "eq", "value": "click"}]), "event_id", block=100)


@query("""with a as (select event_type, event_id, event_id - row_number() over (partition by event_type order by event_id) as g from events)
select event_type, cast(min(event_id) as bigint) as first, cast(max(event_id) as bigint) as last from a group by event_type, g""")
def provenance_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.ranges(read(spark, sf, "events"), "event_id", ["event_type"])


@query(UNIT_SQL + f" select (select count(*) from {BAND_SQL}) as entered, cast(sum(n_rows) as bigint) as used, cast((select count(*) from {BAND_SQL}) - sum(n_rows) as bigint) as dropped from u")
def provenance_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.dropped(read(spark, sf, "events"), _by_user(spark, sf).groups)


# Joins.
@query("select o_orderkey, o_custkey, c_name from orders join customer on o_custkey = c_custkey")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return joins.join(orders(spark, sf), customer(spark, sf), ["o_custkey"], ["c_custkey"]).select(F.col("`left.o_orderkey`").alias("o_orderkey"), F.col("`left.o_custkey`").alias("o_custkey"), F.col("`right.c_name`").alias("c_name"))


@query(f"select c_custkey, o_orderkey, c.segment, o.priority from {CUSTOMER_SQL} c left join {ORDERS_SQL} o on c_custkey = o_custkey")
def join_left(spark: SparkSession, sf: str) -> DataFrame:
    return joins.join(customer(spark, sf), orders(spark, sf), ["c_custkey"], ["o_custkey"], "left").select(F.col("`left.c_custkey`").alias("c_custkey"), F.col("`right.o_orderkey`").alias("o_orderkey"), F.col("`left.segment`").alias("segment"), F.col("`right.priority`").alias("priority"))


@query("select l_orderkey, l_partkey, l_suppkey, count(*) as n from lineitem join (select distinct l_partkey as p, l_suppkey as s from lineitem where l_quantity > 49) x on l_partkey = p and l_suppkey = s group by 1, 2, 3")
def join_composite(spark: SparkSession, sf: str) -> DataFrame:
    t = lineitem(spark, sf)
    few = Table("few", t.df.where("l_quantity > 49").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct())
    out = joins.join(t, few, ["l_partkey", "l_suppkey"], ["p", "s"]).groupBy(*[F.col(f"`left.{c}`").alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey")])
    return out.agg(F.count(F.lit(1)).alias("n"))


def _null_keyed(spark: SparkSession, sf: str) -> tuple[Table, Table]:
    key = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))
    return Table("orders", read(spark, sf, "orders").withColumn("k", key)), Table("customer", read(spark, sf, "customer").withColumn("k", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey"))))


NULL_SQL = "(select *, case when o_custkey % 5 <> 0 then o_custkey end as k from orders) o", "(select *, case when c_custkey % 4 <> 0 then c_custkey end as k from customer) c"


@query(f"select o_orderkey, c_custkey from {NULL_SQL[0]} left join {NULL_SQL[1]} on o.k = c.k")
def join_null_key(spark: SparkSession, sf: str) -> DataFrame:
    return joins.join(*_null_keyed(spark, sf), ["k"], ["k"], "left").select(F.col("`left.o_orderkey`").alias("o_orderkey"), F.col("`right.c_custkey`").alias("c_custkey"))


DIAG_SQL = f"""with o as (select * from {NULL_SQL[0]}), c as (select * from {NULL_SQL[1]}), a as (select k, count(*) as ln from o where k is not null group by k), b as (select k, count(*) as rn from c where k is not null group by k), f as (select * from a full join b using (k))"""


@query(DIAG_SQL + """ select (select count(*) from o) as left_rows, (select count(*) from c) as right_rows, (select count(*) from o where k is null) as left_incomplete, (select count(*) from c where k is null) as right_incomplete,
  count(ln) as left_distinct, count(rn) as right_distinct, count(*) filter (ln is not null and rn is not null) as matched_keys, cast(sum(ln) filter (rn is not null) as bigint) as left_matched_rows, cast(sum(rn) filter (ln is not null) as bigint) as right_matched_rows,
  cast(sum(ln * rn) + (select count(*) from o) - sum(ln) filter (rn is not null) as bigint) as total_result_rows,
  case when max(ln) <= 1 and max(rn) <= 1 then 'one_to_one' when max(ln) <= 1 then 'one_to_many' when max(rn) <= 1 then 'many_to_one' else 'many_to_many' end as cardinality from f""")
def join_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return joins.diagnostics(*_null_keyed(spark, sf), ["k"], ["k"], "left")


@query("select case when max(n) > 1 then 'many_to_many' end as cardinality, cast((select sum(a.n * b.n) from (select l_partkey as k, count(*) as n from lineitem group by 1) a join (select l_suppkey as k, count(*) as n from lineitem group by 1) b using (k)) as bigint) as total_result_rows from (select l_partkey, count(*) as n from lineitem group by 1)")
def join_total_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = lineitem(spark, sf)
    return joins.diagnostics(t, t, ["l_partkey"], ["l_suppkey"]).select("cardinality", "total_result_rows")


@query("select count(*) as text_matches, (select count(*) from orders join customer on cast(o_custkey as double) = c_custkey) as number_matches from orders where false")
def join_type_strict(spark: SparkSession, sf: str) -> DataFrame:
    o, c = orders(spark, sf), customer(spark, sf)
    text = Table("customer", c.df.withColumn("k", F.col("c_custkey").cast("string")))
    double = Table("customer", c.df.withColumn("k", F.col("c_custkey").cast("double")))
    a = joins.join(o, text, ["o_custkey"], ["k"]).agg(F.count(F.lit(1)).alias("text_matches"))
    b = joins.join(o, double, ["o_custkey"], ["k"]).agg(F.count(F.lit(1)).alias("number_matches"))
    return a.join(b, how="cross")


def _crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    """Two written forms of two thirds of the customers."""
    c = read(spark, sf, "customer").where("c_custkey % 3 <> 0")
    one = c.select(F.concat(F.lit("C-"), F.col("c_custkey")).alias("form"), F.concat(F.lit("id"), F.col("c_custkey")).alias("canonical_id"))
    return one.unionByName(c.select(F.concat(F.lit("cust"), F.col("c_custkey")).alias("form"), F.concat(F.lit("id"), F.col("c_custkey")).alias("canonical_id")))


def _formed(spark: SparkSession, sf: str) -> tuple[Table, Table]:
    left = Table("customer", read(spark, sf, "customer").withColumn("form", F.concat(F.lit("C-"), F.col("c_custkey"))))
    right = Table("orders", read(spark, sf, "orders").withColumn("form", F.concat(F.lit("cust"), F.col("o_custkey"))))
    return left, right


@query("select c_custkey, o_orderkey, 'id' || c_custkey as canonical_id from customer join orders on c_custkey = o_custkey where c_custkey % 3 <> 0")
def join_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    out = joins.resolved_join(*_formed(spark, sf), ["form"], ["form"], crosswalk=_crosswalk(spark, sf))
    return out.select(F.col("`left.c_custkey`").alias("c_custkey"), F.col("`right.o_orderkey`").alias("o_orderkey"), F.col("`key.canonical_id`").alias("canonical_id"))


@query("""select count(*) filter (c_custkey % 3 <> 0) as mapped_rows, count(distinct c_custkey) filter (c_custkey % 3 <> 0) as mapped_distinct, count(*) filter (c_custkey % 3 = 0) as unmapped_rows, count(distinct c_custkey) filter (c_custkey % 3 = 0) as unmapped_distinct, cast(0 as bigint) as incomplete_rows from customer""")
def join_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    return identity.mapping_facts(identity.resolve(_formed(spark, sf)[0], ["form"], crosswalk=_crosswalk(spark, sf)))


@query("select n_nationkey, c_custkey from nation join customer on n_nationkey = c_nationkey")
def join_key_format(spark: SparkSession, sf: str) -> DataFrame:
    a = Table("nation", read(spark, sf, "nation"))
    b = Table("customer", read(spark, sf, "customer").join(read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region")), "c_nationkey"))
    out = joins.resolved_join(a, b, ["n_regionkey", "n_nationkey"], ["region", "c_nationkey"], left_key_format="{n_regionkey}-{n_nationkey}", right_key_format="{region}-{c_nationkey}")
    return out.select(F.col("`left.n_nationkey`").alias("n_nationkey"), F.col("`right.c_custkey`").alias("c_custkey"))


@query("select cast(n_regionkey as varchar) || n_nationkey as rendered, count(distinct (n_regionkey, n_nationkey)) as raw_keys, count(*) as n_rows from (select n_regionkey, n_nationkey from nation union all select 1, 1 union all select 11, 1 union all select 1, 11) group by 1 having count(distinct (n_regionkey, n_nationkey)) > 1")
def join_collision_render(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.sql("select * from values (1, 1), (11, 1), (1, 11) as t(n_regionkey, n_nationkey)")
    t = Table("nation", read(spark, sf, "nation").select("n_regionkey", "n_nationkey").unionByName(extra))
    return identity.rendering_collisions(identity.resolve(t, ["n_regionkey", "n_nationkey"], "{n_regionkey}{n_nationkey}"))


@query("select 'id' || c_custkey as canonical_id, count(distinct f) as forms, count(*) as n_rows from (select c_custkey, 'C-' || c_custkey as f from customer union all select o_custkey, 'cust' || o_custkey from orders) where c_custkey % 3 <> 0 group by 1 having count(distinct f) > 1")
def join_collision_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _formed(spark, sf)
    both = Table("both", a.df.select("form").unionByName(b.df.select("form")))
    return identity.crosswalk_collisions(identity.resolve(both, ["form"], crosswalk=_crosswalk(spark, sf)))


@query(f"select c.segment, count(*) as n, round(cast(sum(cast(o_totalprice as decimal(38,4))) as double) / count(o_totalprice), 4) as mean_price from orders join {CUSTOMER_SQL} c on o_custkey = c_custkey group by 1")
def aggjoin_group(spark: SparkSession, sf: str) -> DataFrame:
    out = joins.aggregate_join(orders(spark, sf), customer(spark, sf), ["o_custkey"], ["c_custkey"], [{"op": "count", "name": "n"}, {"op": "mean", "column": "left.o_totalprice", "name": "mean_price"}], ["right.segment"], reasons=False)
    return _rounded(out.withColumnRenamed("right.segment", "segment"), "mean_price", places=4)


@query(f"""with u as (select o_custkey, any_value(c_nationkey) as nation, count(*) as n_rows, cast(sum(cast(o_totalprice as decimal(38,4))) as double) as spent from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'P' group by 1)
select nation, count(*) as n_units, cast(sum(n_rows) as bigint) as n_rows, round(median(spent), 4) as median_spent from u group by 1""")
def aggjoin_unit(spark: SparkSession, sf: str) -> DataFrame:
    got = joins.aggregate_join(
        orders(spark, sf), customer(spark, sf), ["o_custkey"], ["c_custkey"], [{"op": "median", "column": "spent", "name": "median_spent"}], ["right.c_nationkey"], [{"column": "left.o_orderstatus", "op": "ne", "value": "P"}],
        unit=["left.o_custkey"], unit_metrics=[{"op": "sum", "column": "left.o_totalprice", "name": "spent"}], reasons=False,
    )
    return _rounded(got.groups.withColumnRenamed("right.c_nationkey", "nation").select("nation", "n_units", "n_rows", "median_spent"), "median_spent", places=4)


@query("select 'id' || c_custkey as canonical_id, count(*) as n from customer join orders on c_custkey = o_custkey where c_custkey % 3 <> 0 group by 1")
def aggjoin_key(spark: SparkSession, sf: str) -> DataFrame:
    out = joins.aggregate_join(*_formed(spark, sf), ["form"], ["form"], [{"op": "count", "name": "n"}], ["key.canonical_id"], resolved={"crosswalk": _crosswalk(spark, sf)})
    return out.withColumnRenamed("key.canonical_id", "canonical_id")


# Relationships.
def _tables(spark: SparkSession, sf: str) -> dict[str, Table]:
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").alias("Nation Key"), F.col("n_regionkey").alias("region_key"), "n_name")
    return {
        "nation": Table("nation", nation), "region": Table("region", read(spark, sf, "region").select(F.col("r_regionkey").alias("Region-Key"), F.col("r_name").alias("name"))),
        "supplier": Table("supplier", read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation_key"))),
    }


@query("select * from (values ('nation', 'region', 'region_key', 'Region-Key', 'region_key'), ('nation', 'supplier', 'Nation Key', 'nation_key', 'nation_key')) t(\"left\", \"right\", left_key, right_key, normal)")
def rel_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return relationships.candidates(relationships.column_facts(_tables(spark, sf)))


REL_SQL = DIAG_SQL + """, d as (select count(ln) as left_distinct, count(rn) as right_distinct, count(*) filter (ln is not null and rn is not null) as matched_keys, cast(sum(ln * rn) as bigint) as joined_rows,
  case when max(ln) <= 1 and max(rn) <= 1 then 'one_to_one' when max(ln) <= 1 then 'one_to_many' when max(rn) <= 1 then 'many_to_one' else 'many_to_many' end as cardinality from f)"""


@query(REL_SQL + " select (select count(*) from o) as left_rows, (select count(*) from o where k is null) as left_incomplete, left_distinct, (select count(*) from c) as right_rows, (select count(*) from c where k is null) as right_incomplete, right_distinct, matched_keys, cast(matched_keys as double) / left_distinct as left_coverage, cast(matched_keys as double) / right_distinct as right_coverage, cardinality, joined_rows from d")
def rel_assess(spark: SparkSession, sf: str) -> DataFrame:
    return relationships.assess(*_null_keyed(spark, sf), ["k"], ["k"])


@query(REL_SQL + " select round(cast(matched_keys as double) / left_distinct, 6) as left_coverage, round(cast(matched_keys as double) / right_distinct, 6) as right_coverage from d")
def rel_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(relationships.assess(*_null_keyed(spark, sf), ["k"], ["k"]).select("left_coverage", "right_coverage"), "left_coverage", "right_coverage")


@query(REL_SQL + " select case when matched_keys = 0 or cardinality <> 'one_to_one' then 'rejected' else 'declared' end as strict, case when matched_keys = 0 or cardinality <> 'many_to_one' then 'rejected' else 'declared' end as fitting from d")
def rel_status(spark: SparkSession, sf: str) -> DataFrame:
    a = relationships.assess(*_null_keyed(spark, sf), ["k"], ["k"])
    return a.select(relationships.status_column("declared", "one_to_one").alias("strict"), relationships.status_column("declared", "many_to_one").alias("fitting"))


@query(DIAG_SQL + " select k as k0, ln as left_rows, rn as right_rows from f where ln is not null and rn is not null order by k limit 10")
def rel_examples(spark: SparkSession, sf: str) -> DataFrame:
    return relationships.examples(*_null_keyed(spark, sf), ["k"], ["k"])


# Profiles.
def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "orders")
    return p.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "5-LOW", "NA").when(F.col("o_orderpriority") == "1-URGENT", " ").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_orderstatus")).alias("state"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("false").alias("done"), F.lit(None).cast("string").alias("nothing"),
    )


PROFILED_SQL = """(select cast(o_orderkey as varchar) as id, case when o_orderpriority = '5-LOW' then 'NA' when o_orderpriority = '1-URGENT' then ' ' else o_orderpriority end as priority, case when o_orderstatus = 'P' then 'unknown' else o_orderstatus end as state,
  cast(cast(o_totalprice as decimal(18,2)) as varchar) as price, case when o_orderstatus = 'F' then 'True' else 'false' end as done, cast(null as varchar) as nothing from orders)"""
CELLS_SQL = "with cells as (" + " union all ".join(f"select {i} as position, '{c}' as name, {c} as token from {PROFILED_SQL}" for i, c in enumerate("id priority state price done nothing".split())) + """),
k as (select *, trim(token) as v, case when token is null or trim(token) = '' then 'empty' when lower(trim(token)) in ('na') then 'sentinel' when lower(trim(token)) in ('unknown') then 'ambiguous' else 'value' end as kind from cells),
p as (select position, name, count(*) as rows, count(*) filter (kind in ('value', 'ambiguous')) as n_values, count(*) filter (kind = 'empty') as missing_empty, count(*) filter (kind = 'sentinel') as missing_sentinel, count(*) filter (kind = 'ambiguous') as ambiguous,
  count(distinct v) filter (kind in ('value', 'ambiguous')) as n_distinct,
  case when count(*) filter (kind in ('value', 'ambiguous')) = 0 then 'empty' when bool_and(regexp_full_match(v, '[+-]?[0-9]+')) filter (kind in ('value', 'ambiguous')) then 'integer'
    when bool_and(regexp_full_match(v, '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?')) filter (kind in ('value', 'ambiguous')) then 'number' when bool_and(lower(v) in ('true', 'false')) filter (kind in ('value', 'ambiguous')) then 'boolean' else 'string' end as dtype from k group by 1, 2)"""


@query(CELLS_SQL + " select name, rows, n_values, n_distinct, dtype from p")
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile(_profiled(spark, sf)).select("name", "rows", "n_values", "n_distinct", "dtype")


@query(CELLS_SQL + " select name, dtype from p")
def profile_dtype(spark: SparkSession, sf: str) -> DataFrame:
    return profile.facts(_profiled(spark, sf)).select("name", "dtype")


@query(CELLS_SQL + " select name, missing_empty + missing_sentinel as missing, missing_empty, missing_sentinel, ambiguous from p")
def profile_missing_split(spark: SparkSession, sf: str) -> DataFrame:
    return profile.facts(_profiled(spark, sf)).select("name", "missing", "missing_empty", "missing_sentinel", "ambiguous")


@query(CELLS_SQL + " select k.name, v as value, count(*) as n from k join p using (name) where kind in ('value', 'ambiguous') and n_distinct <= 25 group by 1, 2")
def profile_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_values(_profiled(spark, sf))


@query("""with c as (select c_custkey as pos, c_nationkey as v from customer), f as (select v, min(pos) as pos from c group by v order by 2 limit 11), e as (select max(pos) as edge, count(*) as k from f)
select k <= 10 as exact, case when k <= 10 then k else 11 + (select count(*) from c where pos > edge) end as bound from e""")
def profile_distinct_bound(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_bound(Table("customer", read(spark, sf, "customer"), "c_custkey"), "c_nationkey", listed=10)


@query("""select name, case when bool_or(length(v) > 40 or len(list_filter(string_split_regex(v, '\\s+'), lambda t: length(regexp_replace(t, '[^\\p{L}]', '', 'g')) >= 2)) >= 4) then 'prose'
  when bool_or(n = 1 and len(list_filter(string_split_regex(v, '\\s+'), lambda t: length(regexp_replace(t, '[^\\p{L}]', '', 'g')) >= 2)) >= 2) then 'unrepeated-words' end as withheld
  from (select 'kind' as name, p_type as v, count(*) as n from part group by 2 union all select 'note', 'a word ' || r_name, count(*) from region group by 2 union all select 'long', 'one two three ' || r_name, count(*) from region group by 2)
  group by name having count(*) <= 25 union all select 'kind', null where (select count(distinct p_type) from part) > 25""")
def profile_free_text(spark: SparkSession, sf: str) -> DataFrame:
    a = profile.profile(read(spark, sf, "part").select(F.col("p_type").alias("kind")))
    b = profile.profile(read(spark, sf, "region").select(F.concat(F.lit("a word "), F.col("r_name")).alias("note"), F.concat(F.lit("one two three "), F.col("r_name")).alias("long")))
    return a.unionByName(b).select("name", "withheld")


@query("select 'id' as name, count(distinct o_orderkey) = count(*) as \"unique\" from orders")
def profile_unique(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile(_profiled(spark, sf)).where("name = 'id'").select("name", "unique")


@query("select count(*) >= 4 and count(distinct c_custkey) = count(*) and count(distinct c_nationkey) * 2 <= count(*) and count(distinct c_mktsegment) * 2 <= count(*) and (count(distinct c_nationkey) >= 2 or count(distinct c_mktsegment) >= 2) as registry from customer")
def profile_registry(spark: SparkSession, sf: str) -> DataFrame:
    return profile.is_registry(profile.profile(read(spark, sf, "customer").select(F.col("c_custkey").alias("Subject ID"), "c_nationkey", "c_mktsegment")))


@query(f"select count(*) as count, count(price) as non_missing, count(*) filter (price is null) as n_missing, min(price) as min, max(price) as max, round(cast(sum(cast(price as decimal(38,4))) as double) / count(price), 4) as mean from {ORDERS_SQL}")
def describe_variable(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(profile.describe(orders(spark, sf), "price"), "mean", places=4)


# Intervals.
PAIR_SQL = """with e as (select *, epoch_us(ts) / 1e6 as t, case event_type when 'view' then 'STATE' when 'click' then 'STATE' when 'error' then 'POINT' when 'signup' then null else 'State event' end as kind from events),
r as (select *, row_number() over w as k, lead(t) over w as nt from e window w as (partition by user_id, event_type order by t, event_id)),
i as (select user_id, event_type, t as start, case when kind ilike 'state%' then nt when kind = 'POINT' then t end as stop, case when kind = 'POINT' then 'point' when kind is null then 'unknown_type' when nt is not null then 'paired' else 'unmatched_start' end as outcome
  from r where kind is null or kind = 'POINT' or k % 2 = 1)"""


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    types = F.when(F.col("event_type").isin("view", "click"), "STATE").when(F.col("event_type") == "error", "POINT").when(F.col("event_type") != "signup", "State event")
    e = read(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("event_index"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), types.alias("type"))
    return intervals.pair(e, ["user_id", "event_type"])


@query(PAIR_SQL + " select user_id, event_type, round(start, 6) as start, round(stop, 6) as stop, round(stop - start, 4) as duration, outcome from i")
def interval_pairing(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_rounded(_paired(spark, sf).select("user_id", "event_type", "start", "stop", "duration", "outcome"), "start", "stop"), "duration", places=4)


@query(PAIR_SQL + " select outcome, count(*) as n from i group by 1")
def interval_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, count(*) as n_events, min(epoch_us(ts)) as first_time, max(epoch_us(ts)) as last_time from events group by 1")
def interval_observations(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.observations(read(spark, sf, "events").withColumn("time", F.unix_micros(F.col("ts").cast("timestamp"))), "user_id")


@query("select p_size as code, case when count(distinct p_brand) = 1 then any_value(p_brand) end as type, count(distinct p_brand) > 1 as conflict from part group by 1")
def interval_ethogram(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.ethogram(read(spark, sf, "part").select(F.col("p_size").alias("code"), F.col("p_brand").alias("type"), F.lit("x").alias("category"))).drop("category")


@query("select user_id, case when bool_or(event_type = 'error') then null else round(sum(value), 4) end as media_duration from events group by 1")
def interval_media(spark: SparkSession, sf: str) -> DataFrame:
    m = read(spark, sf, "events").select("user_id", F.col("event_id").cast("string").alias("name"), F.when(F.col("event_type") != "error", F.col("value")).alias("length"))
    return _rounded(intervals.media_duration(m, "user_id").drop("media"), "media_duration", places=4)


# Answer algebra.
@query("with a as (select o_custkey as k, count(*) as v from orders group by 1), b as (select o_custkey as k, count(*) as v from orders where o_orderstatus <> 'P' group by 1) select count(*) filter (a.k is not null and b.k is not null) as compared, count(*) filter (a.k is not null and b.k is not null and a.v <> b.v) as mismatches, count(*) filter (b.k is null) as only_in_a, count(*) filter (a.k is null) as only_in_b from a full join b on a.k = b.k")
def gold_compare(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    n = lambda d: d.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return gold.compare(n(o), n(o.where("o_orderstatus <> 'P'")), "k", "v")


@query("with r as (select o_custkey as k, o_orderstatus as v from orders union all select c_custkey, 'F' from customer) select k, count(distinct v) as n_values from r group by 1 having count(distinct v) > 1")
def gold_consistency(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return gold.consistency([o, read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("F").alias("v"))], "k", "v")


@query("select count(*) as checked, count(*) filter (l_linenumber > 3) as mismatches from lineitem")
def gold_sum_check(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.col("l_discount") + F.col("l_tax")
    return gold.sum_check(read(spark, sf, "lineitem"), F.when(F.col("l_linenumber") > 3, parts + 1).otherwise(parts), F.col("l_discount") + F.col("l_tax"))


@query("select c_custkey as k from customer except select o_custkey from orders")
def gold_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return gold.set_difference(read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query("with u as (select c_custkey, any_value(c_mktsegment) as segment, cast(sum(cast(o_totalprice as decimal(38,4))) as double) as v from orders join customer on o_custkey = c_custkey group by 1) select segment, count(*) as n, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as sd, round(stddev_samp(v) / sqrt(count(*)), 4) as sem from u group by 1")
def gold_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    both = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_mktsegment", "segment")
    return _rounded(gold.group_stats(both, "c_custkey", "segment", "o_totalprice", "sum", 4), "mean", "sd", "sem", places=4)


@query(f"select segment, count(*) as n from {CUSTOMER_SQL} where segment is not null group by 1")
def gold_group_count(spark: SparkSession, sf: str) -> DataFrame:
    return gold.group_count(customer(spark, sf).df, ["segment"])


@query(f"select distinct segment as value from {CUSTOMER_SQL} where segment is not null")
def gold_values(spark: SparkSession, sf: str) -> DataFrame:
    return gold.values(customer(spark, sf).df, "segment")


@query(f"select count(segment) as n, count(distinct segment) as kinds from {CUSTOMER_SQL}")
def gold_count(spark: SparkSession, sf: str) -> DataFrame:
    c = customer(spark, sf).df
    return gold.count(c, "segment").join(gold.count(c, "segment", True).withColumnRenamed("n", "kinds"), how="cross")


@query("select p_partkey, case when regexp_full_match(p_brand, 'Brand#([0-9])([0-9])') then regexp_replace(p_brand, '^Brand#([0-9])([0-9])$', '\\2-\\1') when regexp_full_match(p_brand, '[A-Z].*') then 'other' end as brand from part")
def gold_transform(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", gold.transform(F.col("p_brand"), [(r"Brand#([0-9])([0-9])", "$2-$1"), ("[A-Z].*", "other")]).alias("brand"))


@query(f"select c_custkey, case when segment is not null then c_nationkey || '/' || segment end as label from {CUSTOMER_SQL}")
def gold_template(spark: SparkSession, sf: str) -> DataFrame:
    return customer(spark, sf).df.select("c_custkey", gold.template([F.col("c_nationkey"), "/", F.col("segment")]).alias("label"))


@query("select o_orderpriority as kind, count(*) as asked, count(*) filter (o_orderkey % 5 <> 0) as answered, count(*) filter (o_orderkey % 5 <> 0 and o_orderkey % 3 <> 0) as \"right\" from orders group by 1")
def score_answers(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    expected = o.select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("expected"))
    answers = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")).otherwise("none").alias("answer"))
    return gold.score(expected, answers.dropDuplicates(["o_orderkey"]), "o_orderkey", "kind")


# Texts, identity and terms.
@query("""with l as (select page_id, unnest(string_split(html, chr(10))) as line, generate_subscripts(string_split(html, chr(10)), 1) as n from pages),
h as (select page_id, n, rtrim(unnest(regexp_extract_all(line, '\\bhttps?://[^\\s"''<>)\\]]+')), '.,;') as value from l)
select page_id, 'uri' as scheme, value, cast(min(n) as bigint) as line from h where not contains(value, 'doi.org/') group by 1, 3""")
def identifier_scan(spark: SparkSession, sf: str) -> DataFrame:
    return identifiers.scan(read(spark, sf, "pages"), "page_id", "html").where("scheme = 'uri'")


@query("select url as value, 'uri' as schemes, true as valid from pages where regexp_full_match(url, 'https?://[^\\s\"''<>)\\]]+')")
def identifier_validate(spark: SparkSession, sf: str) -> DataFrame:
    return identifiers.validate(read(spark, sf, "pages"), "url").where("valid")


@query("select 'sha256:' || sha256(string_agg(url || chr(10) || 'sha256:' || sha256(html) || chr(10), '' order by url, sha256(html))) as dataset_id from pages")
def dataset_fold(spark: SparkSession, sf: str) -> DataFrame:
    return files.fold(read(spark, sf, "pages").select(F.col("url").alias("path"), F.concat(F.lit("sha256:"), F.sha2("html", 256)).alias("sha256")))


TERMS_SQL = "(select 't' || lpad(p_partkey::varchar, 7, '0') as iri, p_name as label, p_type as syn, p_brand as def, string_split(lower(p_type), ' ') as st from part)"


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.concat(F.lit("t"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("iri"), F.col("p_name").alias("label"), F.array("p_type").alias("synonyms"), F.col("p_brand").alias("definition"))


@query("""with t as (select 't' || lpad(p_partkey::varchar, 7, '0') as iri, lower(p_name) as label, lower(p_type) as syn, list_distinct(regexp_extract_all(lower(p_name) || ' ' || lower(p_type), '[a-z0-9]+')) as names, list_distinct(regexp_extract_all(lower(p_brand), '[a-z0-9]+')) as def, ['steel', 'brand'] as q from part),
s as (select iri, case when label = 'steel brand' then 1.0 when syn = 'steel brand' then 0.95 else 0.8 * len(list_intersect(q, names)) / len(list_distinct(list_concat(q, names))) + 0.15 * len(list_intersect(q, def)) / 2 end as score,
  case when label = 'steel brand' then 'exact_label' when syn = 'steel brand' then 'exact_synonym' when len(list_intersect(q, names)) > 0 then 'token_overlap' else 'definition_overlap' end as match from t)
select iri, round(score, 4) as score, match from s where score > 0 order by score desc, iri limit 20""")
def ontology_search(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.search(_terms(spark, sf), "Steel brand", 20)


@query("""with recursive c(node, ancestor, depth) as (select cast(c_custkey as varchar), cast(c_custkey // 2 as varchar), 1 from customer where c_custkey > 1 union all select c.node, cast(cast(c.ancestor as bigint) // 2 as varchar), depth + 1 from c where cast(c.ancestor as bigint) > 1)
select distinct node, ancestor from c""")
def ontology_closure(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "customer").where("c_custkey > 1").select(F.col("c_custkey").cast("string").alias("node"), F.expr("cast(c_custkey div 2 as string)").alias("parent"))
    return ontology.closure(e)


@query("""with recursive c(node, ancestor) as (select c_custkey, c_custkey // 2 from customer where c_custkey // 2 > 0 union select c.node, p.c_custkey // 2 from c join customer p on p.c_custkey = c.ancestor where p.c_custkey // 2 > 0)
select cast(node as varchar) as node, cast(ancestor as varchar) as ancestor from c""")
def ontology_closure_whole(spark: SparkSession, sf: str) -> DataFrame:
    parent = F.expr("cast(nullif(c_custkey div 2, 0) as string)")  # the root has none
    return ontology.closure(read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("node"), parent.alias("parent")))


@query("select 'n' || n_nationkey as iri, case when n_nationkey = 3 then 'deprecated_term' when n_nationkey = 5 then 'kind_mismatch' when n_regionkey = 2 then 'excluded' when n_regionkey = 1 then 'admissible' else 'outside_scope' end as verdict from nation")
def ontology_scope(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    iri = F.concat(F.lit("n"), F.col("n_nationkey"))
    terms = n.select(iri.alias("iri"), F.lit("geo").alias("ontology"), F.when(F.col("n_nationkey") == 5, "property").otherwise("class").alias("kind"), (F.col("n_nationkey") == 3).alias("deprecated"))
    ancestors = n.select(iri.alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("ancestor"))
    return ontology.scope(terms, ancestors, ontology.Field(branches=["r1"], kinds=["class"], exclude_branches=["r2"]))


@query("with n as (select distinct lower(p_name) as name, p_partkey from part), v as (select distinct p_name as value from part), m as (select value, count(p_partkey) as k, min('t' || p_partkey) as iri from v left join n on lower(value) = name group by 1) select value, case when k = 1 then 'mapped' else 'ambiguous' end as status, case when k = 1 then iri end as iri from m")
def ontology_mapping(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    terms = p.select(F.concat(F.lit("t"), F.col("p_partkey")).alias("iri"), F.col("p_name").alias("label"), F.array().cast("array<string>").alias("synonyms"))
    return ontology.exact_matches(p.select(F.col("p_name").alias("value")), terms)


@query("select distinct 'p' as namespace, p_brand as term from part where p_brand not in (select p_brand from part where p_size < 5)")
def ontology_undefined(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select(F.lit("p").alias("namespace"), F.col("p_brand").alias("term"), "p_size")
    return ontology.undefined_terms(p, p.where("p_size < 5"))


# Assessment.
@query("select 'fail' as result, 'mystery,xlsx' as detail")
def fair_format_openness(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    kind = F.when(F.col("n_nationkey") == 1, "xlsx").when(F.col("n_nationkey") == 2, "mystery").otherwise("csv")
    return assessment.format_openness(n.select(F.col("n_name").alias("path"), kind.alias("format"), F.lit("data").alias("role")))


@query("select 'fail' as result, count(*) filter (o_orderpriority = '5-LOW' or o_orderstatus = 'P') + count(*) filter (o_orderpriority = '5-LOW' and o_orderstatus = 'P') as tokens from orders")
def fair_missing_convention(spark: SparkSession, sf: str) -> DataFrame:
    return assessment.missing_values_declared(profile.profile(_profiled(spark, sf), ["priority", "state"]), declared=False)


@query("select case r_regionkey % 3 when 0 then 'pass' when 1 then 'fail' else 'unknown' end as result, count(*) as n from region group by 1")
def fair_summary(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("r_regionkey") % 3
    return assessment.summary(read(spark, sf, "region").select(F.when(k == 0, "pass").when(k == 1, "fail").otherwise("unknown").alias("result")))


@query("select count(*) as rules, count(*) filter (n_nationkey % 5 <> 0) as judged, count(*) filter (n_nationkey % 5 <> 0 and n_nationkey % 2 = 0) as agree, count(*) filter (n_nationkey % 5 <> 0 and n_nationkey % 2 = 1) as overclaimed from nation")
def score_agreement(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    odd = F.col("n_nationkey") % 2 == 1
    want = n.select(F.col("n_name").alias("rule"), F.when(odd, "unknown").otherwise("pass").alias("result"))
    return assessment.agreement(want, n.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("rule"), F.lit("pass").alias("result")))


@query("with a as (select c_custkey as k, c_nationkey as s from customer), b as (select c_custkey as k, case when c_custkey % 10 = 1 then c_nationkey + 1 else c_nationkey end as s from customer where c_custkey % 10 <> 0) select cast(coalesce(a.k, b.k) as varchar) as path, case when b.k is null then 'removed' else 'changed' end as change from a full join b on a.k = b.k where b.k is null or a.s <> b.s")
def dataset_drift(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    then = c.select(F.col("c_custkey").cast("string").alias("path"), F.col("c_nationkey").alias("sha256"))
    now = c.where("c_custkey % 10 <> 0").select(F.col("c_custkey").cast("string").alias("path"), F.when(F.col("c_custkey") % 10 == 1, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("sha256"))
    return files.drift(then, now)
