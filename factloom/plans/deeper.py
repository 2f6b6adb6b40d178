"""Registered queries of reading in ranges, one grouping for all relationships, selection, pairing in blocks and comparisons that refuse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as aggregating
from ..operators import crosswalks, evidence, gold, identity, inclusion, intervals, joins, ontology, provenance, selection
from ..session import shared
from ..sources import behaviour, delimited
from ..types import Table
from .catalogue import _rounded, _terms, lineitem, orders, query, read
from .further import BEHAVED_SQL, behaved


# Files that Spark writes from a whole table, one a task, each with its own header, and that are read back in ranges.
def _written_files(spark: SparkSession, sf: str) -> str:
    """Customers as delimited text: two lines a name, quotes inside quotes, a further cell for every seventh, two cells less for every
    eleventh. Every other file has its columns in another order."""
    k = F.col("c_custkey")
    note = F.concat(F.lit('"'), F.col("c_name"), F.lit('\n""'), F.col("c_mktsegment"), F.lit('"""'))
    cells = [k.cast("string"), note, F.col("c_nationkey").cast("string")]
    one = lambda order: F.when(k % 11 == 0, cells[order[0]]).otherwise(F.concat_ws(",", *[cells[i] for i in order], F.when(k % 7 == 0, F.lit("more"))))
    rows = read(spark, sf, "customer").repartition(6, "c_custkey").select(one([0, 1, 2]).alias("forth"), one([0, 2, 1]).alias("back"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        odd = TaskContext.get().partitionId() % 2
        header = ["who:,me", "id,nation,note" if odd else "id,note,nation"]
        for i, batch in enumerate(batches):
            lines = batch.column(odd)
            if i == 0:
                lines = pa.concat_arrays([pa.array(header, lines.type), lines])
            yield pa.RecordBatch.from_arrays([lines], names=["value"])

    path = f"{shared(spark)}/customers"
    rows.mapInArrow(headed, "value string").write.text(path)
    return path


@query("""select cast(c_custkey as varchar) as id, case when c_custkey % 11 <> 0 then c_name || chr(10) || '"' || c_mktsegment || '"' end as note, case when c_custkey % 11 <> 0 then cast(c_nationkey as varchar) end as nation from customer""")
def source_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Records that cross lines and ranges, columns of several files by name."""
    return delimited.read(spark, _written_files(spark, sf)).select("id", "note", "nation")


@query("""select cast(count(*) as bigint) as rows, count(*) filter (c_custkey % 11 = 0 or c_custkey % 7 = 0) as ragged, count(*) filter (c_custkey % 11 = 0) as shorter, count(*) filter (c_custkey % 7 = 0 and c_custkey % 11 <> 0) as longer, 3 as width from customer""")
def source_ragged(spark: SparkSession, sf: str) -> DataFrame:
    per = delimited.ragged(spark, _written_files(spark, sf))
    return per.agg(*[F.sum(c).cast("long").alias(c) for c in ("rows", "ragged", "shorter", "longer")], F.max("width").cast("int").alias("width"))


# Relationships.
_SIDES = (("customer", ("c_custkey",)), ("orders", ("o_custkey",)), ("lineitem", ("l_partkey", "l_suppkey")), ("lineitem", ("l_suppkey",)), ("supplier", ("s_suppkey",)), ("nation", ("n_nationkey",)), ("customer", ("c_nationkey",)), ("events", ("user_id",)))
_KEYS_SQL = " union all ".join(f"select {i} as p, concat_ws('/', {', '.join(k)}) as v, count(*) as n from {t} group by 2" for i, (t, k) in enumerate(_SIDES))


@query(f"""with g as ({_KEYS_SQL}), f as (select p, cast(sum(n) as bigint) as rows, count(*) as keys, max(n) as most from g group by p),
m as (select a.p as x, b.p as y, count(*) as matched_keys, cast(sum(a.n * b.n) as bigint) as joined_rows from g a join g b on a.v = b.v and a.p < b.p and (a.p = 2) = (b.p = 2) group by 1, 2)
select a.p as "left", b.p as "right", a.rows as left_rows, a.keys as left_distinct, b.rows as right_rows, b.keys as right_distinct, coalesce(matched_keys, 0) as matched_keys, coalesce(joined_rows, 0) as joined_rows,
  case when a.most = 1 and b.most = 1 then 'one_to_one' when a.most = 1 then 'one_to_many' when b.most = 1 then 'many_to_one' else 'many_to_many' end as cardinality from f a join f b on a.p < b.p left join m on m.x = a.p and m.y = b.p""")
def rel_all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """What every two of eight keys of six tables share, by one grouping of all their values."""
    tables = {t: Table(t, read(spark, sf, t)) for t, _ in _SIDES}
    probes = [inclusion.Probe(t, k) for t, k in _SIDES]
    pairs = [(a, b) for i, a in enumerate(probes) for b in probes[i + 1 :]]
    facts, both = inclusion.measure(tables, probes, pairs)
    names = ["left_rows", "left_distinct", "right_rows", "right_distinct", "matched_keys", "joined_rows", "cardinality"]
    rows = [(probes.index(a), probes.index(b), *(inclusion.assessed(facts[a], facts[b], both[a, b])[n] for n in names)) for a, b in pairs]
    return spark.createDataFrame(rows, "left int, right int, left_rows long, left_distinct long, right_rows long, right_distinct long, matched_keys long, joined_rows long, cardinality string")


# Selection.
@query("select l_linestatus, median(l_extendedprice) as m, count(*) as n from lineitem group by 1")
def agg_median_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of groups that are too large to be gathered, whatever the size of the table."""
    t = lineitem(spark, sf)
    m = selection.medians(t.df, ["l_linestatus"], "l_extendedprice", "m", gathered=1000)
    n = aggregating.aggregate(t, [{"op": "count", "name": "n"}], ["l_linestatus"])
    return m.join(n, "l_linestatus")


@query("select median(o_totalprice) as m from orders")
def agg_median_whole(spark: SparkSession, sf: str) -> DataFrame:
    """One group of nearly all-distinct values."""
    return selection.medians(orders(spark, sf).df, [], "o_totalprice", "m", gathered=1000)


# Units below the join, with groups and filters of both sides.
@query("""with u as (select l_orderkey, o_orderpriority as p, min(l_returnflag) as a, max(l_returnflag) as b, cast(sum(cast(l_quantity as decimal(38,4))) as double) as q, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where l_discount > 0.02 and o_orderstatus <> 'P' group by 1, 2)
select p as priority, a as flag, count(*) as n_units, cast(sum(n) as bigint) as n_rows, round(avg(q), 6) as mean_quantity from u where a = b group by 1, 2""")
def unit_below_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose lines lie in several groups are left out; one filter is on lines, one on orders."""
    got = joins.aggregate_join(
        lineitem(spark, sf), Table("orders", read(spark, sf, "orders")), ["l_orderkey"], ["o_orderkey"], [{"op": "mean", "column": "quantity", "name": "mean_quantity"}], ["right.o_orderpriority", "left.l_returnflag"],
        [{"column": "left.l_discount", "op": "gt", "value": 0.02}, {"column": "right.o_orderstatus", "op": "ne", "value": "P"}], "inner", ["left.l_orderkey"], [{"op": "sum", "column": "left.l_quantity", "name": "quantity"}], "exclude", False,
    ).groups
    out = got.withColumnRenamed("right.o_orderpriority", "priority").withColumnRenamed("left.l_returnflag", "flag").select("priority", "flag", "n_units", "n_rows", "mean_quantity")
    return _rounded(out, "mean_quantity")


# Intervals.
@query(f"""with r as (select *, row_number() over w as k, lead(t) over w as nt from {BEHAVED_SQL} window w as (partition by user_id, event_type order by t, i))
select cast(user_id as varchar) as file, event_type as behavior, case when event_type = 'view' and user_id % 3 = 0 then 'point' when event_type = 'view' and nt is null then 'unmatched_start' when event_type = 'view' then 'paired' else 'unknown_type' end as outcome, count(*) as n
  from r where event_type <> 'view' or user_id % 3 = 0 or k % 2 = 1 group by 1, 2, 3""")
def behaviour_intervals_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Projects that call the same code a state and a point do not disturb each other; codes that a project does not define are untyped."""
    conf = lambda kind: F.create_map(F.lit("0"), F.struct(F.lit("view").alias("code"), F.lit(kind).alias("type"), F.lit("").alias("category")))
    kinds = F.when(F.col("user_id") % 3 == 0, conf("Point event")).otherwise(conf("State event"))
    out = behaviour.intervals(behaved(spark, sf, kinds))
    return out.groupBy("file", "behavior", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select *, epoch_us(ts) / 1e6 as t from events), r as (select *, row_number() over w as k, lead(t) over w as nt from e window w as (partition by event_type order by t, event_id))
select event_type, case when nt is null then 'unmatched_start' else 'paired' end as outcome, count(*) as n, round(sum(nt - t), 2) as duration from r where k % 2 = 1 group by 1, 2""")
def interval_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Few keys that hold all rows: each is paired in blocks of time over many tasks."""
    e = read(spark, sf, "events").select("event_type", F.col("event_id").alias("event_index"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), F.lit("STATE").alias("type"))
    out = intervals.pair(e, ["event_type"], long_rows=500).groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"))
    return _rounded(out, "duration", places=2)


# Comparisons.
@query("select o_custkey as k, count(*) as n from orders group by 1 having count(*) > 1")
def gold_compare_refused(spark: SparkSession, sf: str) -> DataFrame:
    """The keys for which a comparison by customer is refused unless it says how their rows become one."""
    return gold.repeated(read(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), "k")


@query("""with a as (select l_orderkey as k, round(cast(sum(cast(l_quantity as decimal(38,4))) as double), 4) as v from lineitem group by 1), b as (select l_orderkey as k, round(cast(sum(cast(l_quantity as decimal(38,4))) as double), 4) as v from lineitem where l_linenumber < 6 group by 1)
select count(*) filter (a.k is not null and b.k is not null) as compared, count(*) filter (a.k is not null and b.k is not null and a.v <> b.v) as mismatches, count(*) filter (b.k is null) as only_in_a, count(*) filter (a.k is null) as only_in_b from a full join b on a.k = b.k""")
def gold_compare_reduced(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    return gold.compare(rows, rows.where("l_linenumber < 6"), "k", "l_quantity", reduce="sum")


# Terms.
@query("""with recursive c(node, root) as (select c_custkey, c_custkey from customer where c_custkey in (3, 5, 12) union select k.c_custkey, c.root from c join customer k on k.c_custkey // 2 = c.node or (k.c_custkey % 5 = 0 and k.c_custkey // 3 = c.node) where k.c_custkey > c.node)
select cast(c_custkey as varchar) as iri, case when c_custkey in (select node from c where root = 12) then 'excluded' when c_custkey in (select node from c where root in (3, 5)) then 'admissible' else 'outside_scope' end as verdict from customer""")
def ontology_scope_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Terms with one or two parents, judged by the branches that they reach; no pair of a term and an ancestor is stored."""
    c = read(spark, sf, "customer")
    node = F.col("c_custkey").cast("string").alias("node")
    edges = c.where("c_custkey > 1").select(node, F.expr("cast(c_custkey div 2 as string)").alias("parent")).unionAll(c.where("c_custkey % 5 = 0 and c_custkey > 5").select(node, F.expr("cast(c_custkey div 3 as string)").alias("parent")))
    terms = c.select(F.col("c_custkey").cast("string").alias("iri"), F.lit("o").alias("ontology"), F.lit("class").alias("kind"), F.lit(False).alias("deprecated"))
    return ontology.scope_of(terms, edges, ontology.Field(branches=["3", "5"], exclude_branches=["12"]))


# Crosswalks.
def _one_file(spark: SparkSession, lines: DataFrame, header: str, order: str) -> str:
    """Lines below a header as one file, in order."""
    path = f"{shared(spark)}/crosswalk"
    head = spark.createDataFrame([(-1, header)], f"{order} long, value string")
    head.unionAll(lines.select(F.col(order).cast("long"), "value")).coalesce(1).sortWithinPartitions(order).select("value").write.text(path)
    return path


@query("""with c as (select c_custkey as k, row_number() over (order by c_custkey) + 1 as line from customer)
select cast(line as bigint) as line, case when k % 50 = 0 then 'empty' when k % 13 = 0 then 'repeated' else 'claimed' end as problem, case when k % 50 = 0 or k % 13 <> 0 then 'C-' || (case when k % 7 = 0 then k - 1 else k end) else 'C-1' end as form,
  cast(case when k % 50 = 0 then null when k % 13 = 0 then (select line from c where k = 1) else line - 1 end as bigint) as first_line
from c where k <> 1 and (k % 50 = 0 or k % 13 = 0 or (k % 7 = 0 and (k - 1) % 50 <> 0 and (k - 1) % 13 <> 0))""")
def crosswalk_problems(spark: SparkSession, sf: str) -> DataFrame:
    """A crosswalk of all customers with empty ids, forms of other ids and repeated pairs; each with its line."""
    k = F.col("c_custkey")
    again = (k % 13 == 0) & (k % 50 != 0)
    form = F.when(again, "C-1").otherwise(F.concat(F.lit("C-"), F.when(k % 7 == 0, k - 1).otherwise(k)))
    name = F.when(k % 50 == 0, "").when(again, "id1").otherwise(F.concat(F.lit("id"), k))
    lines = read(spark, sf, "customer").select("c_custkey", F.concat_ws(",", name, form).alias("value"))
    return crosswalks.problems(crosswalks.cells_of(spark, _one_file(spark, lines, "canonical_id,form", "c_custkey")))


@query("""with o as (select case when o_custkey % 10 = 0 then null when o_custkey % 3 = 0 then 'x' || o_custkey when o_custkey % 4 = 0 then 'id' || o_custkey when o_orderkey % 2 = 0 then 'a' || o_custkey else 'b' || o_custkey end as form, o_custkey as k from orders),
m as (select form, k, left(form, 1) in ('a', 'b') and exists (select 1 from customer where c_custkey = k) as mapped from o), t as (select form, k, mapped, count(*) as n from m where form is not null group by all),
f as (select k, count(*) as forms from t where mapped group by k), c as (select distinct c_custkey as k from customer where c_custkey % 2 = 0 and c_custkey % 3 <> 0)
select (select cast(coalesce(sum(n), 0) as bigint) from t where mapped) as mapped_rows, (select cast(coalesce(sum(n), 0) as bigint) from t where not mapped) as unmapped_rows, (select count(*) from o where form is null) as incomplete_rows,
  (select count(*) from t where mapped) as mapped_distinct_values, (select count(*) from t where not mapped) as unmapped_distinct_values, (select count(*) from t) as distinct_forms, (select bool_and(n = 1) from t) as forms_unique,
  (select count(*) from f) as mapped_distinct_canonical_ids, (select count(*) from f where forms > 1) as canonical_ids_with_several_forms, (select max(forms) from f) as max_forms_per_canonical_id,
  (select count(*) from (select distinct mapped, case when mapped then cast(k as varchar) else form end as key from t) u where not (mapped and key in (select cast(k as varchar) from c))) as unmatched_distinct_keys,
  (select count(*) from t where not mapped and left(form, 2) = 'id' and k in (select c_custkey from customer)) as unmapped_equal_to_a_canonical_id""")
def crosswalk_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that write their customer in several ways, against some of the customers; the crosswalk holds two forms of all of them."""
    c = read(spark, sf, "customer")
    name = F.concat(F.lit("id"), "c_custkey")
    forms = c.select(F.concat(F.lit("a"), "c_custkey").alias("form"), name.alias("canonical_id")).unionAll(c.select(F.concat(F.lit("b"), "c_custkey"), name))
    k = F.col("o_custkey")
    text = F.when(k % 10 != 0, F.when(k % 3 == 0, F.concat(F.lit("x"), k)).when(k % 4 == 0, F.concat(F.lit("id"), k)).when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("a"), k)).otherwise(F.concat(F.lit("b"), k)))
    left = identity.resolve(Table("orders", read(spark, sf, "orders").select(text.alias("form"))), ["form"], None, forms)
    right = identity.resolve(Table("customer", c.where("c_custkey % 2 = 0 and c_custkey % 3 <> 0").select(F.concat(F.lit("a"), "c_custkey").alias("form"))), ["form"], None, forms)
    return crosswalks.mapping_facts(left, right, forms)


# Contributors.
_ISLANDS_SQL = """with a as (select event_type, event_id, event_id - row_number() over (partition by event_type order by event_id) as g from events where event_id % 9 <> 0), i as (select event_type, min(event_id) as f, max(event_id) as l from a group by event_type, g)"""


@query(_ISLANDS_SQL + " select event_type, cast(sum(l - f + 1) as bigint) as rows, count(*) as n_ranges, string_agg(f || '-' || l, ',' order by f) as ranges from i group by 1")
def provenance_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """What the answer for each kind of event rests on, whole lists."""
    out = provenance.contributions(read(spark, sf, "events").where("event_id % 9 <> 0"), "event_id", ["event_type"], most=1 << 30)
    text = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["first"], r["last"])), ",")
    return out.select("event_type", "rows", "n_ranges", text.alias("ranges"))


@query(_ISLANDS_SQL + " select event_type, cast(sum(l - f + 1) as bigint) as rows, count(*) as n_ranges, count(*) <= 100 as complete from i group by 1")
def provenance_capped_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of over a hundred ranges are counted and not kept."""
    return provenance.contributions(read(spark, sf, "events").where("event_id % 9 <> 0"), "event_id", ["event_type"], most=100).select("event_type", "rows", "n_ranges", "complete")


_SEARCH_SQL = """with t as (select 't' || lpad(p_partkey::varchar, 7, '0') as iri, p_size, lower(p_name) as label, lower(p_type) as syn, list_distinct(regexp_extract_all(lower(p_name) || ' ' || lower(p_type), '[a-z0-9]+')) as names, list_distinct(regexp_extract_all(lower(p_brand), '[a-z0-9]+')) as def from part),
q as (select s_suppkey as qid, lower(case when s_suppkey % 3 = 0 then p_type when s_suppkey % 3 = 1 then p_name || ' ' || p_brand else p_type || ' unknown ' || p_brand end) as text from supplier join part on p_partkey = s_suppkey),
a as (select qid, text, list_distinct(regexp_extract_all(text, '[a-z0-9]+')) as asked from q),
s as (select qid, iri, p_size, case when label = text then 1.0 when syn = text then 0.95 else 0.8 * len(list_intersect(asked, names)) / len(list_distinct(list_concat(asked, names))) + 0.15 * len(list_intersect(asked, def)) / len(asked) end as score from a, t)"""


def _searches(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.concat_ws(" ", "p_type", F.lit("unknown"), "p_brand"))
    return read(spark, sf, "supplier").join(read(spark, sf, "part"), F.col("p_partkey") == k).select(k.alias("qid"), text.alias("query"))


@query(_SEARCH_SQL + ", r as (select *, row_number() over (partition by qid order by score desc, iri) as rank from s where score > 0 and p_size <= 25) select qid, cast(rank as int) as rank, iri, round(score, 4) as score from r where rank <= 5")
def ontology_search_many(spark: SparkSession, sf: str) -> DataFrame:
    """A query for every supplier against all parts of a size, by an index of tokens."""
    scope = read(spark, sf, "part").where("p_size <= 25").select(F.concat(F.lit("t"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("iri"))
    return ontology.search_many(_terms(spark, sf), _searches(spark, sf), 5, scope).drop("match")


@query(_SEARCH_SQL + " select qid, count(*) filter (score > 0 and p_size > 25) as out_of_scope_matches from s group by 1")
def ontology_out_of_scope(spark: SparkSession, sf: str) -> DataFrame:
    scope = read(spark, sf, "part").where("p_size <= 25").select(F.concat(F.lit("t"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("iri"))
    return ontology.out_of_scope(_terms(spark, sf), _searches(spark, sf), scope)


# Evidence.
_CLAIMS_SQL = """(select distinct 'clm_' || substr(sha256('{"claim":"customer ' || o_custkey || ' has an order of status ' || o_orderstatus || '","evidence":[{"check":"table.row-count","result":"' || o_orderstatus || '","source":"orders"},{"check":"file.size","result":"","source":"orders#' || o_custkey || '"}],"subject":"' || o_custkey || '"}'), 1, 16) as claim_id,
  'customer ' || o_custkey || ' has an order of status ' || o_orderstatus as claim, cast(o_custkey as varchar) as subject from orders)"""


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    subject = F.col("o_custkey").cast("string")
    item = lambda check, result, source: F.struct(F.lit(check).alias("check"), result.alias("result"), source.alias("source"))
    items = F.array(item("table.row-count", F.col("o_orderstatus"), F.lit("orders")), item("file.size", F.lit(None).cast("string"), F.concat(F.lit("orders#"), subject)))
    return evidence.recorded(o.select(F.concat(F.lit("customer "), subject, F.lit(" has an order of status "), "o_orderstatus").alias("claim"), subject.alias("subject"), items.alias("evidence")))


@query(f"select * from {_CLAIMS_SQL} c")
def evidence_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """A claim for every order; repeated ones are kept once."""
    return _claims(spark, sf).drop("evidence")


@query(f"select claim_id, subject from {_CLAIMS_SQL} c where contains(claim, 'status P') and ends_with(subject, '7')")
def evidence_found(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.query(_claims(spark, sf), check="file.size", contains="STATUS p").where(F.col("subject").endswith("7")).select("claim_id", "subject")
