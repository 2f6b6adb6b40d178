"""More registered queries beside their SQL: sources, guards, evidence, assessment, answer algebra, terms."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..operators import aggregate as aggregating
from ..operators import annotations, assessment, checks, evidence, filters, gold, identifiers, identity, joins, ontology, principles, profile, provenance, relationships
from ..session import shared
from ..sources import behaviour, blocks, delimited, files, layout, structured
from ..types import Table
from .catalogue import CELLS_SQL, CUSTOMER_SQL, DIAG_SQL, EVENTS_SQL, NULL_SQL, ORDERS_SQL, _crosswalk, _formed, _null_keyed, _profiled, _rounded, customer, events, orders, query, read


# Sums over magnitudes that no single decimal holds.
@query("""select l_linenumber as k, case when l_linenumber = 1 then cast(count(*) || 'e-13' as double) when l_linenumber = 2 then cast(count(*) || 'e25' as double) when l_linenumber = 3 then cast(sum(cast(l_quantity as decimal(38,4))) as double) end as total
  from lineitem where l_linenumber <= 3 group by 1""")
def agg_sum_magnitudes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber")
    t = Table("lineitem", read(spark, sf, "lineitem").where(k <= 3).withColumn("x", F.when(k == 1, 1e-13).when(k == 2, 1e25).otherwise(F.col("l_quantity"))).withColumn("k", k), None, {"x": 4})
    return aggregating.aggregate(t, [{"op": "sum", "column": "x", "name": "total"}], ["k"], reasons=False)


@query(f"""select priority, count(price) as n, round(cast(sum(cast(price as decimal(38,4))) as double) / count(price), 4) as mean, case when count(price) = 0 then 'no non-missing values' end as mean_reason,
  case when count(price) > 1 then round(stddev_samp(price), 2) end as sd, case when count(price) = 0 then 'no non-missing values' when count(price) < 2 then 'sd is undefined for fewer than 2 non-missing values (n=' || count(price) || ')' end as sd_reason from {ORDERS_SQL} group by 1""")
def agg_with_reasons(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregating.aggregate(orders(spark, sf), [{"op": "n_present", "column": "price", "name": "n"}, {"op": "mean", "column": "price", "name": "mean"}, {"op": "sd", "column": "price", "name": "sd"}], ["priority"])
    return _rounded(_rounded(out.withColumnRenamed("mean:reason", "mean_reason").withColumnRenamed("sd:reason", "sd_reason"), "mean", places=4), "sd", places=2)


# Joins: guards, pages, mappings.
@query(DIAG_SQL.replace("from o where", "from o where").replace("with o as", "with o as") + """ select case when max(ln) <= 1 and max(rn) <= 1 then 'one_to_one' when max(ln) <= 1 then 'one_to_many' when max(rn) <= 1 then 'many_to_one' else 'many_to_many' end as cardinality, cast(sum(ln * rn) as bigint) as total_result_rows from f""")
def join_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """Cardinality on rendered keys: what the join compares, not the columns as they stand."""
    return joins.resolved_diagnostics(*_null_keyed(spark, sf), ["k"], ["k"], left_key_format="c{k}", right_key_format="c{k}").select("cardinality", "total_result_rows")


@query("""with a as (select max(n) as n from (select count(*) as n from lineitem group by l_partkey)), b as (select max(n) as n from (select count(*) as n from lineitem group by l_suppkey))
select t.way, case when a.n > 1 and b.n > 1 then 'refused' else 'joined' end as outcome from a, b, (values ('plain'), ('rendered')) t(way)""")
def aggjoin_refused(spark: SparkSession, sf: str) -> DataFrame:
    t = Table("lineitem", read(spark, sf, "lineitem"))
    rows = []
    for way, resolved in (("plain", None), ("rendered", {"left_key_format": "p{l_partkey}", "right_key_format": "p{l_suppkey}"})):
        try:
            joins.aggregate_join(t, t, ["l_partkey"], ["l_suppkey"], [{"op": "count"}], resolved=resolved)
            rows.append((way, "joined"))
        except QueryValidationError:
            rows.append((way, "refused"))
    return spark.createDataFrame(rows, "way string, outcome string")


@query("""with a as (select count(*) as n from orders group by o_custkey), b as (select count(*) as n from customer group by c_custkey)
select case when (select max(n) from a) > 1 and (select max(n) from b) = 1 then 'right' end as replicated, case when (select max(n) from a) > 1 then 'rows of the right side repeat in the result; a metric over its columns counts them once per match' end as warning""")
def aggjoin_replicated(spark: SparkSession, sf: str) -> DataFrame:
    return joins.remarks(joins.diagnostics(orders(spark, sf), customer(spark, sf), ["o_custkey"], ["c_custkey"])).select("replicated", "warning")


@query(f"select c_custkey, o_orderkey from {CUSTOMER_SQL} left join orders on c_custkey % 1000 = o_orderkey order by c_custkey, o_orderkey limit 40")
def join_page(spark: SparkSession, sf: str) -> DataFrame:
    c = customer(spark, sf)
    left, right = Table("customer", c.df.withColumn("k", F.col("c_custkey") % 1000), "c_custkey"), Table("orders", read(spark, sf, "orders"), "o_orderkey")
    rows = joins.join(left, right, ["k"], ["o_orderkey"], "left")
    return joins.page(left, right, ["k"], ["o_orderkey"], rows, 40).select(F.col("`left.c_custkey`").alias("c_custkey"), F.col("`right.o_orderkey`").alias("o_orderkey"))


@query("""select count(*) as rows, count(*) filter (c_custkey % 3 <> 0) as canonical_rows, count(*) filter (c_custkey % 3 = 0) as unmapped_rows, cast(0 as bigint) as rendered_rows, cast(0 as bigint) as keyless_rows, count(distinct c_custkey) as keys
  from customer join orders on c_custkey = o_custkey where c_custkey % 3 <> 0""")
def join_mapping_counts(spark: SparkSession, sf: str) -> DataFrame:
    return joins.mapping_counts(joins.resolved_join(*_formed(spark, sf), ["form"], ["form"], crosswalk=_crosswalk(spark, sf)))


@query("select 'C-' || c_custkey as form, 'id' || c_custkey as canonical_id from customer")
def crosswalk_parse(spark: SparkSession, sf: str) -> DataFrame:
    """A crosswalk file, which is a bounded declaration, read strictly."""
    keys = [r[0] for r in read(spark, sf, "customer").select("c_custkey").toLocalIterator()]
    content = "﻿canonical_id,note,form\r\n" + "".join(f'id{k},"a, b",C-{k}\r\n' for k in keys)
    return identity.parse_crosswalk(content.encode(), "customers").rows(spark)


@query("""select 'rel_' || substr(sha256('{"dataset_id":"d","left":{"keys":["' || r_name || '"],"table":"a"},"right":{"keys":["k"],"table":"b"}}'), 1, 20) as id from region""")
def rel_ids(spark: SparkSession, sf: str) -> DataFrame:
    names = [r[0] for r in read(spark, sf, "region").select("r_name").collect()]
    return spark.createDataFrame([(relationships.relationship_id("d", "a", "b", [n], ["k"]),) for n in names], "id string")


@query("""select * from (values ('nation', 'region', 'declared', 'many_to_one', 25), ('nation', 'supplier', 'candidate', (select case when max(n) > 1 then 'one_to_many' else 'one_to_one' end from (select count(*) as n from supplier group by s_nationkey)), (select count(*) from supplier))) t("left", "right", status, cardinality, joined_rows)""")
def rel_build(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").alias("nation_key"), F.col("n_regionkey").alias("region_key"), "n_name")
    tables = {"nation": Table("nation", nation), "region": Table("region", read(spark, sf, "region").select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("name"))), "supplier": Table("supplier", read(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation_key")))}
    found = relationships.build(spark, "d", tables, [{"left": "nation", "right": "region", "left_keys": ["region_key"], "right_keys": ["region_key"], "expected_cardinality": "many_to_one"}])
    return spark.createDataFrame([(r["left"], r["right"], r["status"], r["cardinality"], r["joined_rows"]) for r in found], "left string, right string, status string, cardinality string, joined_rows long")


@query("select count(*) as joined_rows, 'declared' as status, count(distinct c_custkey) as matched_keys from customer join orders on c_custkey = o_custkey where c_custkey % 3 <> 0")
def rel_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    a, b = joins.resolved_sides(*_formed(spark, sf), ["form"], ["form"], crosswalk=_crosswalk(spark, sf))
    return relationships.assess(a, b, ["__space", "__key"], ["__space", "__key"]).select("joined_rows", relationships.status_column("declared", "one_to_many").alias("status"), "matched_keys")


@query(f"""with l as (select k, list(o_orderkey order by o_orderkey)[1:10] as rows from {NULL_SQL[0]} where k is not null group by k), r as (select k, list(c_custkey order by c_custkey)[1:10] as rows from {NULL_SQL[1]} where k is not null group by k)
select l.k as k0, array_to_string(l.rows, ',') as left_locators, array_to_string(r.rows, ',') as right_locators from l join r using (k) order by k limit 10""")
def rel_locators(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _null_keyed(spark, sf)
    out = relationships.examples(Table("orders", a.df, "o_orderkey"), Table("customer", b.df, "c_custkey"), ["k"], ["k"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("k0", text("left_locators"), text("right_locators"))


# Provenance.
@query(f"""with a as (select event_id, event_id - row_number() over (order by event_id) as g from {EVENTS_SQL} where kind = 'view'), r as (select count(*) as n from a group by g)
select count(*) as ranges, cast(sum(n) as bigint) as rows, count(*) <= 100 as complete from r""")
def provenance_caps(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.capped(filters.filtered(events(spark, sf), [{"column": "kind", "op": "eq", "value": "view"}]), "event_id", most=100)


@query("""select distinct '{"a_line":' || l_linenumber || ',"b_order":' || l_orderkey || '}' as locator from lineitem""")
def provenance_objects(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("b_order"), F.col("l_linenumber").alias("a_line"))
    return provenance.objects(rows, ["b_order", "a_line"])


# Profiles.
@query(CELLS_SQL + " select name, kind, v as token, count(*) as n from k where kind in ('sentinel', 'ambiguous') group by all")
def profile_token_maps(spark: SparkSession, sf: str) -> DataFrame:
    return profile.token_maps(_profiled(spark, sf))


@query(CELLS_SQL + " select name, rows, n_values, missing_empty, missing_sentinel, ambiguous, dtype from p")
def profile_facts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.facts(_profiled(spark, sf)).select("name", "rows", "n_values", "missing_empty", "missing_sentinel", "ambiguous", "dtype")


# Sources. Small files are made from whole small tables first, and then read by the readers.
def _folder(spark: SparkSession) -> str:
    path = shared(spark).removeprefix("file://")
    if "://" in path:
        raise QueryValidationError(f"the readers of single files need a mounted folder, not {path}")
    os.makedirs(path, exist_ok=True)
    return path


def _lines(spark: SparkSession, lines: Sequence[str], name: str) -> str:
    path = os.path.join(_folder(spark), name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("".join(f"{x}\n" for x in lines))
    return path


def _nations(spark: SparkSession, sf: str) -> list[tuple]:
    return [tuple(r) for r in read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


@query("select 2 * n_nationkey + 6 as line, cast(n_nationkey as varchar) as id, n_name || chr(10) || 'x' as note, cast(n_regionkey as varchar) as region from nation")
def source_delimited(spark: SparkSession, sf: str) -> DataFrame:
    """A preamble, a blank record, quoted line breaks and a byte-order mark."""
    rows = [f'{k},"{n}\nx",{r}' for k, n, r in _nations(spark, sf)]
    path = _lines(spark, ["﻿Observer:,someone", "Date:,today", "id,note,region", "", *rows], "nations.csv")
    return delimited.read(spark, path).select(F.col("_source_row").alias("line"), "id", "note", "region")


@query("select '3' as header_row, 'id,note,region' as names, '1:key-value-label,2:key-value-label' as skipped, ';' as delimiter, true as marked")
def source_header(spark: SparkSession, sf: str) -> DataFrame:
    rows = [f"{k};{n};{r}" for k, n, r in _nations(spark, sf)]
    path = _lines(spark, ["﻿Observer:;someone;", "Date:;today;", "id;note;region", *rows], "nations.csv")
    d, header = delimited.header(spark, path)
    return spark.createDataFrame([(str(header.row), ",".join(header.labels), ",".join(f"{r}:{why}" for r, why in header.skipped), d, delimited.marked(path))], "header_row string, names string, skipped string, delimiter string, marked boolean")


@query("""with l as (select list(case when n_nationkey % 4 = 0 then '' else 'c' || n_regionkey end order by n_nationkey) as x from nation)
select i as position, case when x[i] = '' then 'column_' || i when (select count(*) from range(1, i) t(j) where x[j] = x[i]) = 0 then x[i] else x[i] || '.' || (select count(*) from range(1, i) t(j) where x[j] = x[i]) end as name from l, range(1, len(x) + 1) r(i)""")
def source_naming(spark: SparkSession, sf: str) -> DataFrame:
    labels = ["" if k % 4 == 0 else f"c{r}" for k, _, r in _nations(spark, sf)]
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(layout.names(labels))], "position long, name string")


BLOCKS = {"layouts": {"t": {"blocks": [{"name": "regions", "header_row": 2, "last_row": 7, "columns": "A:B"}, {"name": "names", "header_row": 1, "last_row": 7, "columns": "D:D"}, {"name": "nations", "header_row": 10, "header_rows": 2, "last_row": 36, "fill": True}]}}}


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    regions = [tuple(r) for r in read(spark, sf, "region").orderBy("r_regionkey").collect()]
    lines = ["first,,,name", "key,name,,ABC", *[f"{k},{n},,{n.lower()}" for k, n in regions], "second;,,", "who: me", "nation,,", "key,name,region"]
    return blocks.file_records(spark, _lines(spark, [*lines, *[f"{k},{n},{r}" for k, n, r in _nations(spark, sf)], "note: the end"], "t.csv"), delimiter=",")


@query("""select 'regions' as block, r_regionkey + 3 as line, 'key|name' as names, r_regionkey || '|' || r_name as cells from region
  union all select 'names', r_regionkey + 3, 'name', lower(r_name) from region union all select 'names', 2, 'name', 'ABC'
  union all select 'nations', n_nationkey + 12, 'nation / key|nation / name|nation / region', n_nationkey || '|' || n_name || '|' || n_regionkey from nation""")
def source_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Side-by-side and stacked blocks with a composed header, cut out of one file's records."""
    records, declared, out = _blocks(spark, sf), blocks.parse_layouts(BLOCKS)["t"], None
    for b in declared:
        laid = blocks.table(records, b, declared)
        names = [n for n, _ in laid.columns]
        part = laid.df.select(F.lit(b.name).alias("block"), F.col("_source_row").alias("line"), F.lit("|".join(names)).alias("names"), F.concat_ws("|", *[F.col(f"`{n}`") for n in names]).alias("cells"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""select * from (values (8, 'skipped', 0, 'A', 'nation / key', 'second;'), (9, 'skipped', 0, 'A', 'nation / key', 'who: me'), (10, 'header', 0, 'A', 'nation / key', 'nation'),
  (11, 'header', 0, 'A', 'nation / key', 'key'), (11, 'header', 1, 'B', 'nation / name', 'name'), (11, 'header', 2, 'C', 'nation / region', 'region')) t(line, role, position, letter, "column", value)""")
def source_rows_above(spark: SparkSession, sf: str) -> DataFrame:
    records, declared = _blocks(spark, sf), blocks.parse_layouts(BLOCKS)["t"]
    return blocks.above(records, blocks.table(records, declared[2], declared)).withColumnRenamed("row", "line").drop("raw")


@query("select n_nationkey + 3 as line, cast(n_nationkey as varchar) as id, n_name as name, case when n_regionkey % 2 = 0 then 'true' else 'false' end as even from nation")
def source_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """A hidden worksheet with a title above its header: numbers, inline texts and booleans."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    text = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = [f'<row r="{k + 3}"><c r="A{k + 3}"><v>{k}</v></c>{text(f"B{k + 3}", n)}<c r="C{k + 3}" t="b"><v>{1 - r % 2}</v></c></row>' for k, n, r in _nations(spark, sf)]
    head = f'<row r="1">{text("A1", "All nations")}</row><row r="2">{text("A2", "id")}{text("B2", "name")}{text("C2", "even")}</row>'
    path = os.path.join(_folder(spark), "nations.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" state="hidden" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>{head}{''.join(rows)}</sheetData></worksheet>")
    df = blocks.table(blocks.sheet_records(spark, path, "S"), letters=True, blank_rows=True).df
    return df.withColumnRenamed("_source_row", "line")


@query("select lower(n_name) || '.csv' as path, cast(length(n_name) as bigint) as size, 'sha256:' || sha256(n_name) as sha256, 'csv' as format, false as conflict from nation")
def source_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Files are hashed where they lie; excluded folders are left out."""
    folder = _folder(spark)
    os.makedirs(os.path.join(folder, ".git"))
    for name in [f"{n.lower()}.csv" for _, n, _ in _nations(spark, sf)] + [".git/config.csv"]:
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(os.path.basename(name).removesuffix(".csv").upper())
    return files.inventory(spark, folder)


@query("""select page_id, case page_id % 6 when 0 then 'png' when 1 then 'pdf' when 2 then 'parquet' when 3 then 'csv' when 4 then 'json' else 'boris' end as format, page_id % 6 in (0, 1) as conflict from pages""")
def source_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures before extensions; a project is one only if its JSON has the keys of one."""
    k = F.col("page_id") % 6
    body = F.col("html").cast("binary")
    sign = lambda hex_: F.concat(F.unhex(F.lit(hex_)), body)
    project = F.lit('{"project_format_version": "7", "behaviors_conf": {}, "observations": {}}').cast("binary")
    content = F.when(k == 0, sign("89504E470D0A1A0A")).when(k == 1, sign("25504446")).when(k == 2, sign("50415231")).when(k == 3, body).when(k == 4, F.lit('{"a": 1}').cast("binary")).otherwise(project)
    name = F.when(k == 0, "a.csv").when(k == 1, "b.json").when(k == 2, "c.parquet").when(k == 3, "d.csv").when(k == 4, "e.json").otherwise("f.boris")
    return read(spark, sf, "pages").select("page_id", files._format(name, content).alias("d")).select("page_id", "d.format", "d.conflict")


@query("select lower(n_name) || case when n_regionkey % 2 = 0 then '.csv' else '.json' end as path, 'csv' as format from nation where n_regionkey % 2 = 0 and ends_with(n_name, '1')")
def source_listing(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("n_regionkey") % 2 == 0
    f = read(spark, sf, "nation").select(F.concat(F.lower("n_name"), F.when(even, ".csv").otherwise(".json")).alias("path"), F.when(even, "csv").otherwise("json").alias("format"))
    return files.listed(f, "*1.*", "csv")


@query("""select event_id, case event_id % 4 when 0 then 'invalid' when 1 then 'array' else 'object' end as root, case when event_id % 4 = 2 then 'k' when event_id % 4 = 3 then 'a,p' else '' end as keys,
  case event_id % 4 when 0 then null when 3 then 2 else 1 end as items, case event_id % 4 when 0 then 0 when 2 then 2 else 3 end as depth from events""")
def source_json_shape(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("event_id") % 4, F.col("props")
    text = F.when(k == 0, F.concat(p, F.lit("]"))).when(k == 1, F.concat(F.lit("["), p, F.lit("]"))).when(k == 2, p).otherwise(F.concat(F.lit('{"p": '), p, F.lit(', "a": null}')))
    found = structured.shapes(read(spark, sf, "events").withColumn("text", text), "event_id", "text")
    return found.select("event_id", "root", F.array_join("keys", ",").alias("keys"), "items", "depth")


NAMES = ("x/README.md", "LICENSE", "datapackage.json", "a/dataset_description.json", "i_study.txt", "codemeta.json", "datacite.xml", "metadata.yml", "changelog.txt", "ro-crate-metadata.json", "participants.tsv", "data.csv")


@query("select n_nationkey, (['readme', 'license', 'frictionless', 'bids', 'isa-tab', 'codemeta', 'datacite', 'generic', 'changelog', 'ro-crate', 'bids', null])[n_nationkey % 12 + 1] as convention from nation")
def metadata_names(spark: SparkSession, sf: str) -> DataFrame:
    path = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("n_nationkey") % 12).cast("int"))
    return read(spark, sf, "nation").select("n_nationkey", structured.name_column(path).alias("convention"))


@query("select event_id, (['schema-org', 'bids', 'frictionless', 'datacite', null])[event_id % 5 + 1] as standard from events")
def metadata_contents(spark: SparkSession, sf: str) -> DataFrame:
    docs = ({"@context": ["https://schema.org/"]}, {"BIDSVersion": "1.8"}, {"resources": [{"path": "a"}]}, {"titles": ["t"], "creators": ["c"]}, {"name": "x"})
    text = F.get(F.array(*[F.lit(json.dumps(d)) for d in docs]), (F.col("event_id") % 5).cast("int"))
    return structured.content_standards(read(spark, sf, "events").withColumn("text", text), "event_id", "text")


def behaved(spark: SparkSession, sf: str, ethogram: Column) -> DataFrame:
    """A behaviour project a user: the user's events in order of time, one observation; lengths of two media files."""
    e = read(spark, sf, "events").withColumn("t", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 6))
    # A project file holds one user's events; a user's events are what the file format asks to stand in one document.
    per = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type"))), lambda x: F.array(x["t"].cast("string"), F.lit("s"), x["event_type"], F.lit(""), F.lit(""))).alias("events"))
    odd = F.col("user_id") % 2 == 1
    lengths = F.create_map(F.lit("d/a.mp4"), F.lit(60.5), F.lit("d/b.mp4"), F.when(~odd, F.lit(1.5)))
    observation = F.struct(F.create_map(F.lit("1"), F.array(F.lit("d/a.mp4"), F.lit("d/b.mp4"))).alias("file"), F.struct(lengths.alias("length")).alias("media_info"), F.col("events"))
    project = F.struct(F.lit("7.0").alias("project_format_version"), ethogram.alias("behaviors_conf"), F.create_map(F.concat(F.lit("o"), F.col("user_id")), observation).alias("observations"))
    return behaviour.parsed(per.select(F.col("user_id").cast("string").alias("file"), F.to_json(project).alias("value")))


def _projects(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"0": ("view", "State event"), "1": ("click", "State event"), "2": ("error", "Point event"), "3": ("signup", "Point event"), "4": ("signup", "State event")}
    return behaved(spark, sf, F.create_map(*[x for k, (c, t) in kinds.items() for x in (F.lit(k), F.struct(F.lit(c).alias("code"), F.lit(t).alias("type"), F.lit("").alias("category")))]))


BEHAVED_SQL = "(select *, row_number() over (partition by user_id order by epoch_us(ts), event_id) as i, epoch_us(ts) / 1e6 as t from events)"


@query(f"select cast(user_id as varchar) as file, 'o' || user_id as observation_id, cast(i as bigint) as event_index, round(t, 4) as time, event_type as behavior from {BEHAVED_SQL}")
def behaviour_events(spark: SparkSession, sf: str) -> DataFrame:
    out = behaviour.events(_projects(spark, sf)).select("file", "observation_id", F.col("event_index").cast("long").alias("event_index"), "time", "behavior")
    return _rounded(out, "time", places=4)


@query(f"""with r as (select *, row_number() over w as k, lead(t) over w as nt from {BEHAVED_SQL} window w as (partition by user_id, event_type order by t, i))
select cast(user_id as varchar) as file, event_type as behavior, case when event_type = 'error' then 'point' when event_type not in ('view', 'click') then 'unknown_type' when nt is null then 'unmatched_start' else 'paired' end as outcome, count(*) as n,
  round(sum(case when event_type = 'error' then 0 when event_type in ('view', 'click') then nt - t end), 2) as duration from r where event_type not in ('view', 'click') or k % 2 = 1 group by 1, 2, 3""")
def behaviour_intervals(spark: SparkSession, sf: str) -> DataFrame:
    out = behaviour.intervals(_projects(spark, sf)).groupBy("file", "behavior", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"))
    return _rounded(out, "duration", places=2)


@query("select cast(user_id as varchar) as file, 'o' || user_id as observation_id, count(*) as n_events, 'a.mp4 | b.mp4' as media, case when user_id % 2 = 0 then cast(62.0 as double) end as media_duration from events group by user_id")
def behaviour_observations(spark: SparkSession, sf: str) -> DataFrame:
    return behaviour.observations(_projects(spark, sf)).withColumn("n_events", F.col("n_events").cast("long"))


@query("select * from (values ('view', 'State event', false), ('click', 'State event', false), ('error', 'Point event', false), ('signup', null, true)) t(code, type, conflict)")
def behaviour_ethogram(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import intervals

    return intervals.ethogram(behaviour.ethogram(_projects(spark, sf)).select("code", "type", "category").distinct()).select("code", "type", "conflict")


@query("select cast(user_id as varchar) as file, user_id % 3 <> 0 as sound from events group by user_id")
def behaviour_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Every third project has an event without a time: it is not sound."""
    p = _projects(spark, sf)
    third = F.col("file").cast("long") % 3 == 0
    broken = F.transform_values("project.observations", lambda _, o: o.withField("events", F.concat(o["events"], F.array(F.array(F.lit("soon"), F.lit("s"), F.lit("view"))))))
    return behaviour.well_formed(p.withColumn("project", F.when(third, F.col("project").withField("observations", broken)).otherwise(F.col("project"))))


# Identifiers.
ORCID_SQL = "list_reduce(list_prepend(0, list_transform(range(1, 16), lambda i: cast(substr(lpad(c_custkey::varchar, 15, '0'), i, 1) as int))), lambda a, d: (a + d) * 2 % 11)"


@query(f"""select c_custkey, (12 - {ORCID_SQL}) % 11 = c_custkey % 11 as valid from customer""")
def identifier_orcid(spark: SparkSession, sf: str) -> DataFrame:
    """Every key as the first fifteen digits, with a check digit that is right for some."""
    digits = F.lpad(F.col("c_custkey").cast("string"), 15, "0")
    last = F.when(F.col("c_custkey") % 11 == 10, "X").otherwise((F.col("c_custkey") % 11).cast("string"))
    whole = F.concat(digits, last)
    text = F.concat_ws("-", *[F.substring(whole, i, 4) for i in (1, 5, 9, 13)])
    return read(spark, sf, "customer").select("c_custkey", identifiers.orcid_valid(text).alias("valid"))


@query("""select page_id, s as scheme, v as value, n as line from pages, lateral (values ('doi', '10.1234/p' || page_id, 2), ('orcid', '0000-0002-1825-0097', 1), ('rrid', 'RRID:AB:' || page_id, 3), ('ror', 'https://ror.org/02mhbdp94', 4), ('uri', 'https://a.org/' || page_id, 5)) t(s, v, n)""")
def identifier_schemes(spark: SparkSession, sf: str) -> DataFrame:
    """Each scheme, with repeats, trailing punctuation, and URLs of a DOI and a ROR that give way to those."""
    k = F.col("page_id")
    text = F.concat(F.lit("by 0000-0002-1825-0097.\nsee 10.1234/p"), k, F.lit(", again 10.1234/p"), k, F.lit(".\nRRID:AB:"), k, F.lit("; x\nat https://ror.org/02mhbdp94 0000-0002-1825-0097\nhttps://a.org/"), k, F.lit("; https://doi.org/10.1234/p"), k, F.lit(".\n"))
    return identifiers.scan(read(spark, sf, "pages").withColumn("text", text), "page_id", "text").withColumn("line", F.col("line").cast("int"))


@query("""select v as value, s as schemes, ok as valid from region, lateral (values ('10.1234/r' || r_regionkey, 'doi', true), (' https://ror.org/02mhbdp94 ', 'ror', true), ('0000-0002-1825-009' || (7 + r_regionkey % 2), 'orcid', r_regionkey % 2 = 0), ('nothing ' || r_regionkey, '', false), ('https://x.org/' || r_regionkey, 'uri', true)) t(v, s, ok)""".replace("v as value", "trim(v) as value"))
def identifier_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("r_regionkey")
    kinds = F.array(F.concat(F.lit("10.1234/r"), k), F.lit(" https://ror.org/02mhbdp94 "), F.concat(F.lit("0000-0002-1825-009"), 7 + k % 2), F.concat(F.lit("nothing "), k), F.concat(F.lit("https://x.org/"), k))
    return identifiers.validate(read(spark, sf, "region").select(F.explode(kinds).alias("v")), "v")


@query("select 'p' || page_id as \"where\", 'occurrence' as kind, '10.1234/ABC' as value from pages where page_id % 7 = 0 union all select 'canon', 'form', '10.1234/abc'")
def identifier_resolve(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("source"), F.when(F.col("page_id") % 7 == 0, "see 10.1234/ABC").otherwise("nothing").alias("text"))
    cross = spark.createDataFrame([("10.1234/abc", "canon"), ("other", "10.9999/x")], "form string, canonical_id string")
    return identifiers.resolve(identifiers.scan(p, "source", "text"), "10.1234/abc", cross)


# Evidence.
@query("""select 'clm_' || substr(sha256('{"claim":"' || n_name || ' has rows","evidence":[{"check":"table.row-count","result":' || n_nationkey || ',"source":"nation"}],"subject":"' || n_regionkey || '"}'), 1, 16) as claim_id, n_name || ' has rows' as claim, cast(n_regionkey as varchar) as subject from nation""")
def evidence_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated claims are kept once, under an id that their content gives."""
    item = lambda k: [{"check": "table.row-count", "result": k, "source": "nation"}]
    claims = [(f"{n} has rows", str(r), item(k)) for k, n, r in _nations(spark, sf)]
    return evidence.ledger(spark, claims + claims).drop("evidence")


@query("select n_name || ' has rows' as claim, cast(n_regionkey as varchar) as subject from nation where n_regionkey = 1 and n_nationkey % 2 = 0 and contains(lower(n_name), 'nation')")
def evidence_query(spark: SparkSession, sf: str) -> DataFrame:
    claims = [(f"{n} has rows", str(r), [{"check": "table.row-count" if k % 2 == 0 else "file.size", "result": k, "source": "nation"}]) for k, n, r in _nations(spark, sf)]
    return evidence.query(evidence.ledger(spark, claims), "1", "table.row-count", "NATION").select("claim", "subject")


@query(CELLS_SQL + """ select 'column ' || name || ' of orders holds ' || dtype || ' values' as claim, 'orders' as subject, 'table.column-dtype' as "check", dtype as result from p
  union all select 'column ' || name || ' of orders lacks ' || (missing_empty + missing_sentinel) || ' values', 'orders', 'table.missing-value-count', cast(missing_empty + missing_sentinel as varchar) from p""")
def evidence_claims(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.claims_of(profile.facts(_profiled(spark, sf)), "orders")


# Assessment: three packages, one that passes, one that fails, one whose metadata nobody could read.
_GOOD = {"@context": "https://schema.org/", "license": "CC0", "author": "A", "identifier": "https://doi.org/10.1234/abc", "files": ["a.csv"]}
PACKAGES = {
    "good": (checks.Catalogue({"a.csv": "csv", "ro-crate-metadata.json": "json"}, {"ro-crate-metadata.json": "ro-crate"}, (), {"ro-crate-metadata.json": json.dumps(_GOOD)}), {"a": 1}, True),
    "bare": (checks.Catalogue({"a.mat": "matlab", "readme.txt": "text"}, {"readme.txt": "readme"}, (), {"readme.txt": "about 10. things"}), {"a": 1}, False),
    "unread": (checks.Catalogue({"a.csv": "csv", "b.odd": "odd", "m.xlsb": "xlsb"}, {}, ("m.xlsb",)), None, False),
}
RULES = ("F1-PID-METADATA", "F1-PID-RESOLVABLE", "F2-METADATA-PRESENT", "F3-METADATA-LINKS-DATA", "F4-METADATA-MACHINE-READABLE", "A1-RETRIEVAL-PROTOCOL", "I1-DATA-FORMATS-OPEN", "I2-VOCABULARY-REFERENCED", "R1.1-LICENCE-DECLARED", "R1.2-PROVENANCE-DECLARED", "R1.3-COMMUNITY-STANDARD", "R1.3-MISSING-VALUES-DECLARED")
_P, _F, _U, _N = "pass", "fail", "unknown", "not_applicable"
WANTED = {
    "good": (_P, _U, _P, _P, _P, _U, _P, _P, _P, _P, _P, _P),
    "bare": (_F, _U, _P, _F, _F, _U, _F, _F, _F, _F, _F, _F),
    "unread": (_U, _U, _U, _U, _U, _U, _F, _U, _U, _U, _N, _N),
}


@query("select * from (values " + ", ".join(f"('{p}', '{r}', '{v}')" for p, vs in WANTED.items() for r, v in zip(RULES, vs, strict=True)) + ") t(package, rule, result)")
def fair_rules(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, (catalogue, tokens, declared) in PACKAGES.items():
        part = assessment.run(spark, checks.rules(catalogue, tokens, declared)).select(F.lit(name).alias("package"), "rule", "result")
        out = part if out is None else out.unionByName(part)
    return out


@query("""select * from (values ('F1', 'unknown', 1, 0, 3), ('F2', 'unknown', 1, 0, 1), ('F3', 'unknown', 1, 0, 0), ('F4', 'unknown', 1, 0, 3), ('A1', 'unknown', 0, 0, 3), ('A1.1', 'unknown', 0, 0, 3), ('A1.2', 'unknown', 0, 0, 3), ('A2', 'unknown', 0, 0, 3), ('I1', 'unknown', 1, 0, 2), ('I2', 'unknown', 1, 0, 3),
  ('I3', 'unknown', 0, 0, 1), ('R1', 'unknown', 0, 0, 2), ('R1.1', 'unknown', 1, 0, 2), ('R1.2', 'unknown', 1, 0, 1), ('R1.3', 'unknown', 2, 0, 3)) t(principle, verdict, signals, gaps, actions)""")
def fair_principles(spark: SparkSession, sf: str) -> DataFrame:
    """A local pass is a signal and never a verdict; open requirements stay as actions."""
    return principles.table(spark, dict(zip(RULES, WANTED["good"], strict=True)))


@query("select * from (values ('fail', 9), ('unknown', 2)) t(result, n)")
def fair_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    found = principles.recommendations(dict(zip(RULES, WANTED["bare"], strict=True)))
    return spark.createDataFrame([(r["result"], r["rule"]) for r in found], "result string, rule string").groupBy("result").agg(F.count(F.lit(1)).alias("n"))


# Answer algebra.
@query("select cast(sum(cast(l_quantity as decimal(38,4))) as double) as total from lineitem where l_returnflag = 'R'")
def gold_sum(spark: SparkSession, sf: str) -> DataFrame:
    text = read(spark, sf, "lineitem").withColumn("q", F.concat(F.lit(" "), F.col("l_quantity").cast("string")))
    return gold.total(text, "q", F.col("l_returnflag") == "R")


@query("select l_orderkey, l_linenumber, cast(cast(l_discount as decimal(18,4)) + cast(l_tax as decimal(18,4)) as double) as row_sum from lineitem")
def gold_row_sum(spark: SparkSession, sf: str) -> DataFrame:
    return gold.row_totals(read(spark, sf, "lineitem"), ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "row_sum")


def _attached(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    twice = read(spark, sf, "customer").where("c_custkey % 4 <> 0")
    twice = twice.unionByName(twice.where("c_custkey % 3 = 0"))  # rows that repeat a key and agree
    return gold.attach(read(spark, sf, "orders"), twice, F.concat(F.lit("k"), F.col("o_custkey")), F.concat(F.lit("k"), F.col("c_custkey")), ["c_mktsegment", "c_nationkey"], rows_agree=True)


@query("select o_orderkey, c_mktsegment, c_nationkey from orders join customer on o_custkey = c_custkey where c_custkey % 4 <> 0")
def gold_attach(spark: SparkSession, sf: str) -> DataFrame:
    return _attached(spark, sf)[0].select("o_orderkey", "c_mktsegment", "c_nationkey")


@query("select o_orderkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_custkey % 4 <> 0)")
def gold_attach_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return _attached(spark, sf)[1].select("o_orderkey")


@query("select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'part' end as state from orders")
def gold_mapped(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", gold.mapped(F.col("o_orderstatus"), {"F": "done", "O": "open", "P": "part"}).alias("state"))


@query("select (select count(*) from orders) as orders, (select count(distinct c_mktsegment) from customer) as segments, (select cast(sum(cast(c_acctbal as decimal(38,4))) as double) from customer) as balance")
def gold_bundle(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return gold.bundle({"orders": gold.count(read(spark, sf, "orders")), "segments": gold.count(c, "c_mktsegment", True), "balance": gold.total(c, "c_acctbal")})


@query("select case when (select count(*) from customer where c_custkey < 0) = 0 then 'ABSTAIN' end as answer, case when (select count(*) from region) <> 4 then 'refused' end as wrong")
def gold_abstain(spark: SparkSession, sf: str) -> DataFrame:
    none = gold.count(read(spark, sf, "customer").where("c_custkey < 0"))
    try:
        wrong = gold.abstain([(gold.count(read(spark, sf, "region")), 4)])
    except QueryValidationError:
        wrong = "refused"
    return spark.createDataFrame([(gold.abstain([(none, 0)]), wrong)], "answer string, wrong string")


@query("select distinct n_name as value from nation where n_nationkey between 4 and 19 and regexp_full_match(n_name, 'NATION_1.*')")
def gold_raw_range(spark: SparkSession, sf: str) -> DataFrame:
    sheet = read(spark, sf, "nation").select(F.col("n_nationkey").alias("row"), F.col("n_name").alias("B"))
    return gold.raw_range(sheet, "B", 4, 19, "NATION_1.*")


@query("select n_name as one, 'NATION_7' as raw from nation where n_nationkey = 3")
def gold_cell(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    return spark.createDataFrame([(gold.cell(n, F.col("n_nationkey") == 3, "n_name"), gold.raw_cell(n.select(F.col("n_nationkey").alias("row"), F.col("n_name").alias("A")), 7, "A"))], "one string, raw string")


_TESTS = (
    ("eq", 7, "v = '7' or v = '7.0'"), ("ne", "x", "coalesce(v, '') <> 'x'"), ("in", ["7", "x"], "v in ('7', 'x')"), ("not_in", ["7", "x"], "coalesce(v, '') not in ('7', 'x')"), ("empty", None, "coalesce(trim(v), '') = ''"), ("nonempty", None, "coalesce(trim(v), '') <> ''"),
    ("numeric", None, "v in ('7', '7.0')"), ("not_numeric", None, "coalesce(v, '') not in ('7', '7.0')"), ("regex", "[0-9].*", "regexp_full_match(v, '[0-9].*')"), ("gt", 6.5, "v in ('7', '7.0')"), ("le", 7, "v in ('7', '7.0')"), ("ge", 8, "false"), ("lt", 7, "false"), ("span_ge", 2, "v = '1-3.5'"), ("span_lt", 3, "v = '1-3.5'"),
)


@query("with t as (select c_custkey, (['7', '7.0', 'x', ' ', null, '1-3.5'])[c_custkey % 6 + 1] as v from customer) " + " union all ".join(f"select '{op}' as test, count(*) as n from t where {w}" for op, _, w in _TESTS))
def gold_predicates(spark: SparkSession, sf: str) -> DataFrame:
    v = F.get(F.array(*[F.lit(x) for x in ("7", "7.0", "x", " ", None, "1-3.5")]), (F.col("c_custkey") % 6).cast("int"))
    counts = read(spark, sf, "customer").select(v.alias("v")).agg(*[F.count_if(gold.predicate("v", op, value)).alias(op) for op, value, _ in _TESTS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(op).alias("test"), F.col(op).alias("n")) for op, *_ in _TESTS])).alias("r")).select("r.*")


_ASKED = (
    ("number", "10.0", "10.0005", "correct"), ("number", "10.0", "10.5", "incorrect"), ("integer", "4", "4.0", "correct"), ("boolean", "true", "Yes", "correct"), ("set", '["a","b"]', '["B ","a","a"]', "correct"), ("object", '{"a":"1","b":"x"}', '{"b":"X","a":"1"}', "correct"),
    ("table", '[{"k":"1","v":"a"},{"k":"2","v":"b"}]', '[{"k":"2","v":"B"},{"v":"a","k":"1"}]', "correct"), ("exact", "Some  Text", "some text", "correct"), ("exact", "ABSTAIN", "abstain", "correct_abstention"), ("exact", "ABSTAIN", "42", "confident_on_unanswerable"), ("exact", "x", "ABSTAIN", "over_abstention"), ("exact", "x", None, "missing"),
)


@query("select c_custkey, (" + str([o for *_, o in _ASKED]) + ")[c_custkey % 12 + 1] as outcome from customer")
def score_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("c_custkey", "outcome")


@query("select c_mktsegment as kind, count(*) as asked, cast(sum(([1, 0, 1, 1, 1, 1, 1, 1, 1, -1, 0, 0])[c_custkey % 12 + 1]) as bigint) as points from customer group by 1")
def score_points(spark: SparkSession, sf: str) -> DataFrame:
    return gold.points(_judged(spark, sf))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    at = (F.col("c_custkey") % 12).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(q[i]) for q in _ASKED]), at)
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("kind"), pick(0).alias("rule"), pick(1).alias("expected"), F.lit(0.001).alias("tolerance"), pick(2).alias("answer"))
    return gold.outcomes(c.drop("answer"), c.where("answer is not null").select("c_custkey", "answer"), "c_custkey")


# Terms.
_CASES = (
    ("f", "mapped", ["http://x/n1"], None, ""), ("f", "mapped", ["http://x/n2"], None, "excluded"), ("f", "mapped", ["http://x/none"], None, "unknown_iri"), ("f", "mapped", ["some label"], None, "label_not_iri"), ("f", "mapped", ["12"], None, "literal_not_allowed"), ("f", "mapped", ["http://x/n1", "http://x/n1"], None, "cardinality_violation"),
    ("f", "mapped", [None], None, "null_value"), ("d", "mapped", ["2026-02-30"], None, "datatype_mismatch"), ("d", "mapped", ["2026-02-28"], None, ""), ("f", "abstain", [], "why", ""), ("f", "abstain", ["http://x/n1"], " ", "value_with_abstention,missing_reason"), ("g", "mapped", ["http://x/n1"], None, "unknown_field"), ("f", "guess", [], None, "unknown_decision"), (None, "mapped", [], None, "malformed"),
)


@query("select c_custkey as id, (" + str([c[-1] for c in _CASES]) + f")[c_custkey % {len(_CASES)} + 1] as codes from customer")
def ontology_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Every code of a mapping's validation, over as many decisions as there are customers."""
    at = (F.col("c_custkey") % len(_CASES)).cast("int")
    case = lambda i, kind: F.get(F.array(*[(F.array(*[F.lit(x).cast("string") for x in c[i]]) if isinstance(c[i], list) else F.lit(c[i])).cast(kind) for c in _CASES]), at)
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), case(0, "string").alias("field"), case(1, "string").alias("decision"), case(2, "array<string>").alias("values"), case(3, "string").alias("reason"))
    fields = spark.createDataFrame([("f", None), ("d", "date")], "field string, datatype string")
    verdicts = spark.createDataFrame([("f", "http://x/n1", "admissible"), ("f", "http://x/n2", "excluded")], "field string, iri string, verdict string")
    return ontology.validate(rows, fields, verdicts).select("id", F.array_join("codes", ",").alias("codes"))


@query("""select 'n' || n_nationkey as iri, n_name as label, 'r' || n_regionkey as parents, '' as children from nation union all select 'r' || r_regionkey, r_name, '', (select string_agg('n' || n_nationkey, ',' order by 'n' || n_nationkey) from nation where n_regionkey = r_regionkey) from region union all select 'x', null, '', ''""")
def ontology_context(spark: SparkSession, sf: str) -> DataFrame:
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    iri = F.concat(F.lit("n"), F.col("n_nationkey"))
    terms = n.select(iri.alias("iri"), F.col("n_name").alias("label")).unionByName(r.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("iri"), F.col("r_name").alias("label")))
    asked = terms.select("iri").unionByName(spark.createDataFrame([("x",)], "iri string"))
    out = ontology.term_context(terms, n.select(iri.alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent")), asked)
    return out.withColumns({c: F.array_join(c, ",") for c in ("parents", "children")})


@query("select * from (values ('color', 'term', 'hue', ''), ('day', 'literal', '', 'date')) t(field, value_type, ontologies, datatype)")
def ontology_constraints(spark: SparkSession, sf: str) -> DataFrame:
    found = ontology.constraints({"day": ontology.Field(datatype="date"), "color": ontology.Field(ontologies=["hue"])})
    return spark.createDataFrame([(r["field"], r["value_type"], ",".join(r["ontologies"]), r["datatype"] or "") for r in found], "field string, value_type string, ontologies string, datatype string")


@query("select 'n' || n_nationkey as iri, n_name as label, 'class' as kind, n_nationkey % 5 = 0 as deprecated, 'r' || n_regionkey as parents from nation")
def ontology_compile(spark: SparkSession, sf: str) -> DataFrame:
    """A document of terms a region, compiled and checked."""
    n = read(spark, sf, "nation")
    term = F.struct(F.concat(F.lit("n"), F.col("n_nationkey")).alias("iri"), F.col("n_name").alias("label"), F.array(F.concat(F.lit("r"), F.col("n_regionkey"))).alias("parents"), F.when(F.col("n_nationkey") % 5 == 0, True).alias("deprecated"))
    docs = n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(term)).alias("value"))
    return ontology.compile_terms(docs).select("iri", "label", "kind", "deprecated", F.array_join("parents", ",").alias("parents"))


@query("select 'segment' as field, 'LOST' as value, 'not_in_source' as fault")
def ontology_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    source = read(spark, sf, "customer").select(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value"))
    record = source.distinct().unionByName(spark.createDataFrame([("segment", "LOST")], "field string, value string"))
    return ontology.faithful(record, source)


@query("""select n_nationkey, '<http://x/' || n_nationkey || '>' as subject, '<http://x/name>' as predicate, '"' || n_name || '"@en' as object from nation""")
def ontology_ntriples(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    line = F.explode(F.array(F.concat(F.lit("<http://x/"), F.col("n_nationkey"), F.lit('> <http://x/name> "'), F.col("n_name"), F.lit('"@en . # a note')), F.lit("# a comment"), F.lit("")))
    return ontology.ntriples(n.select(line.alias("value"))).select(F.regexp_extract("subject", r"(\d+)", 1).cast("int").alias("n_nationkey"), "subject", "predicate", "object")


# Annotations.
@query("select n_nationkey, (['conformant', 'non_conformant', 'partial', 'insufficient_evidence', 'not_applicable'])[n_nationkey % 5 + 1] as label from nation")
def annotation_labels(spark: SparkSession, sf: str) -> DataFrame:
    result = F.get(F.array(*[F.lit(r) for r in ("pass", "fail", "partial", "unknown", "not_applicable")]), (F.col("n_nationkey") % 5).cast("int"))
    return read(spark, sf, "nation").select("n_nationkey", annotations.label_column(result).alias("label"))


@query("select 'c' || n_nationkey as criterion, 'partial' as label from nation where n_regionkey <> 2")
def annotation_references(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation")
    good = n.select(F.concat(F.lit("c"), F.col("n_nationkey")).alias("criterion"), F.lit("partial").alias("label"), F.lit("f").alias("family"), F.lit("v").alias("variant"), F.when(F.col("n_regionkey") == 2, "draft").otherwise("approved").alias("status"), F.lit("human").alias("method"))
    return annotations.reference_labels(good.unionByName(good.withColumn("family", F.lit("other")).withColumn("label", F.lit("pass"))), "f", "v")


@query("select n_regionkey as annotation_id, count(*) as n from nation group by 1 having count(*) > 1")
def annotation_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.repeated_ids(read(spark, sf, "nation").select(F.col("n_regionkey").alias("annotation_id")))
