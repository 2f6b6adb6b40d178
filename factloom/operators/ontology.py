"""Ontology terms: ancestor closure, admissible scope, ranked search, validation of mappings."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryLookupError, QueryValidationError
from ..session import written
from ..types import strip
from . import reach

MOST_TERMS = 50
#: So few edges are closed by doubling at once: their pairs are less work than further rounds.
FEW_EDGES = 50_000
# The weights of the ranking rule.
LABEL, SYNONYM, NAMES, DEFINITION = 1.0, 0.95, 0.8, 0.15


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor) over (node, parent), cycles allowed.

    Nodes without children are taken off round by round while that takes a good part of the edges (``reach.peeled``); what is left, where chains
    are long or nodes lie on cycles, is closed by ``doubled``. Then the rounds are followed back: a node taken off gets its parents and their
    ancestors, so in a tree every pair is made once. Every table is written to the shared folder, which cuts the lineage.
    """
    rest, rounds = reach.peeled(written(edges.select("node", "parent").where("node is not null and parent is not null").distinct(), "closure-edges"), FEW_EDGES)
    known = doubled(rest)
    for taken in reversed(rounds):
        above = taken.join(known.select(F.col("node").alias("parent"), "ancestor"), "parent").where("ancestor != parent")
        # Only a node of several parents can find an ancestor twice; a parent itself comes from its edge.
        one = above.where("single").select("node", "ancestor")
        more = above.where("not single").select("node", "ancestor").unionByName(taken.where("not single").select("node", F.col("parent").alias("ancestor"))).distinct()
        known = known.unionByName(written(one.unionByName(taken.where("single").select("node", F.col("parent").alias("ancestor"))).unionByName(more), "closure"))
    return known


def doubled(edges: DataFrame) -> DataFrame:
    """(node, ancestor) by doubling distances: the pairs that lie as far apart as the last round reached are joined with all pairs known, so
    a pair is met once for every node at that distance on its way. The rounds grow with the logarithm of the depth."""
    known = written(edges.select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("far")), "closure-near")
    far = 1
    while not (last := known.where(F.col("far") == far)).isEmpty():
        longer = last.select("node", F.col("ancestor").alias("via")).join(known.select(F.col("node").alias("via"), "ancestor", "far"), "via")
        found = longer.groupBy("node", "ancestor").agg((F.min("far") + far).alias("far"))
        known = known.unionByName(written(found.join(known, ["node", "ancestor"], "left_anti"), "closure-near"))
        far *= 2
    return known.select("node", "ancestor")


def tokens(c: Column) -> Column:
    """Distinct lower-case alphanumeric tokens, camel case split."""
    text = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[a-z0-9])(?=[A-Z])", " "))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[a-z0-9]+"), F.lit(0)))


@dataclasses.dataclass(frozen=True)
class Field:
    """What a mapping field admits."""

    ontologies: Sequence[str] = ()
    branches: Sequence[str] = ()
    terms: Sequence[str] = ()
    kinds: Sequence[str] = ()
    exclude_terms: Sequence[str] = ()
    exclude_branches: Sequence[str] = ()
    allow_deprecated: bool = False
    datatype: str | None = None


def scope(terms: DataFrame, ancestors: DataFrame, field: Field) -> DataFrame:
    """(iri, verdict): deprecated_term, kind_mismatch, excluded, admissible or outside_scope, tested in that order. ``ancestors`` holds
    every pair; ``scope_of`` needs the edges only."""
    lines = ancestors.groupBy("node").agg(F.collect_set("ancestor").alias("line"))
    rows = terms.join(lines, terms["iri"] == lines["node"], "left")
    return rows.select("iri", verdict(F.array_append(F.coalesce("line", F.array().cast("array<string>")), F.col("iri")), field).alias("verdict"))


def scope_of(terms: DataFrame, edges: DataFrame, field: Field) -> DataFrame:
    """The same over (node, parent), cycles allowed: a term carries the branches of the field that it reaches, not all its ancestors."""
    branches = [*field.branches, *field.exclude_branches]
    found = reach.named(reach.reached(edges, branches), branches)
    rows = terms.join(found, terms["iri"] == found["node"], "left")
    line = F.array_append(F.coalesce("names", F.array().cast("array<string>")), F.col("iri"))
    return rows.select("iri", verdict(line, field).alias("verdict"))


def verdict(line: Column, field: Field) -> Column:
    """The first test that decides a term; ``line`` has the term and those of its ancestors that the field names."""
    meets = lambda names: F.arrays_overlap(line, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)
    among = lambda c, names: F.col(c).isin(*names) if names else F.lit(False)
    out = F.when(F.coalesce(F.col("deprecated"), F.lit(False)) & F.lit(not field.allow_deprecated), "deprecated_term")
    if field.kinds:
        out = out.when(~F.col("kind").isin(*field.kinds), "kind_mismatch")
    out = out.when(among("iri", field.exclude_terms) | meets(field.exclude_branches), "excluded")
    return out.when(among("ontology", field.ontologies) | among("iri", field.terms) | meets(field.branches), "admissible").otherwise("outside_scope")


def asked_tokens(query: str) -> list[str]:
    """``tokens`` of a query that is at hand."""
    return list(dict.fromkeys(re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", query).lower())))


def name_tokens() -> Column:
    """Distinct tokens of a term's label and synonyms."""
    synonyms = F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.lower(s))
    return F.array_distinct(F.concat(tokens(F.lower("label")), F.flatten(F.transform(synonyms, lambda s: F.array_distinct(F.regexp_extract_all(s, F.lit(r"[a-z0-9]+"), F.lit(0)))))))


def heads() -> Column:
    """A term's label and synonyms in lower case, each once."""
    return F.array_distinct(F.concat(F.array(F.lower("label")), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.lower(s))))


def scored(text: Column, asked: Column, names: Column, definition: Column) -> tuple[Column, Column]:
    """(score, match) of a term for a query in lower case and its tokens; ``definition`` has the tokens of the term's definition."""
    synonyms = F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.lower(s))
    share = F.size(F.array_intersect(asked, names)) / F.greatest(F.size(F.array_union(asked, names)), F.lit(1))
    bonus = F.size(F.array_intersect(asked, definition)) / F.greatest(F.size(asked), F.lit(1))
    label, synonym = F.lower("label") == text, F.array_contains(synonyms, text)
    score = F.when(label, LABEL).when(synonym, SYNONYM).otherwise(NAMES * share + DEFINITION * bonus)
    return score, F.when(label, "exact_label").when(synonym, "exact_synonym").when(share > 0, "token_overlap").when(bonus > 0, "definition_overlap").otherwise("none")


def search(terms: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(iri, score, match): the ``k`` best terms over (iri, label, synonyms, definition); ties by iri. Top-k without a full sort."""
    bounded_k(k)
    score, match = scored(F.lit(query.strip().lower()), F.array(*[F.lit(t) for t in asked_tokens(query)]).cast("array<string>"), name_tokens(), tokens(F.col("definition")))
    ranked = terms.select("iri", score.alias("score"), match.alias("match")).where("score > 0")
    return ranked.orderBy(F.desc("score"), "iri").limit(k).withColumn("score", F.round("score", 4))


def bounded_k(k: int) -> None:
    if not isinstance(k, int) or isinstance(k, bool) or not 1 <= k <= MOST_TERMS:
        raise QueryValidationError(f"top_k lies within 1..{MOST_TERMS}")


def search_many(terms: DataFrame, queries: DataFrame, k: int = 5, admissible: DataFrame | None = None) -> DataFrame:
    """(qid, rank, iri, score, match): ``search`` for every row of (qid, query) by an inverted index of tokens, among the terms whose iri
    ``admissible`` holds, where it is given.

    Terms that score alike for every query are one class with its ``k`` least iris, and equal queries are asked once: the ``k`` best terms lie
    in the ``k`` best classes by score and least iri. A query first meets the postings of its rarer half of tokens. A term that it misses
    shares tokens of the other half only, which bounds its score; where the k-th score so far is above that bound the long lists are never
    read. Whole matches of a label or synonym come by an equi-join. Candidates are scored as the scan scores them.
    """
    bounded_k(k)
    if admissible is not None:
        terms = terms.join(admissible.select("iri").distinct(), "iri", "left_semi")
    alike = ["label", "synonyms", "names", "about"]
    synonyms = F.array_sort(F.array_distinct(F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.lower(s))))
    rows = terms.select("iri", F.lower("label").alias("label"), synonyms.alias("synonyms"), F.array_sort(name_tokens()).alias("names"), F.array_sort(tokens(F.col("definition"))).alias("about"))
    least = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*alike).orderBy("iri"))).where(F.col("rank") <= k)
    t = written(least.groupBy(*alike).agg(F.array_sort(F.collect_list("iri")).alias("iris")).withColumn("term", F.monotonically_increasing_id()).withColumn("iri", F.element_at("iris", 1)), "terms")
    postings = written(t.select("term", F.explode(F.array_union("names", "about")).alias("token")), "postings")
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    every = written(queries.select("qid", F.lower(strip(F.col("query"))).alias("text"), F.array_sort(tokens(F.col("query"))).alias("asked")), "queries")
    q = written(every.where("text is not null").select("text", "asked").distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.coalesce("n", F.lit(0)), "token"))
    asked = written(q.select("ask", F.size("asked").alias("a"), F.explode("asked").alias("token")).join(often, "token", "left").withColumn("place", place), "asked")
    lead = F.ceil(F.col("a") / 2)
    whole = t.select("term", F.explode(heads()).alias("text"))

    def met(tokens_of: DataFrame) -> DataFrame:
        return tokens_of.select("ask", "token").join(postings, "token").select("ask", "term").distinct()

    def judged(pairs: DataFrame) -> DataFrame:
        score, match = scored(F.col("text"), F.col("asked"), F.col("names"), F.col("about"))
        return pairs.join(q, "ask").join(t, "term").select("ask", "term", "iri", "iris", score.alias("score"), match.alias("match")).where("score > 0")

    order = Window.partitionBy("ask").orderBy(F.desc("score"), "iri")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    one_by_one = lambda found: top(found.select("ask", F.explode("iris").alias("iri"), "score", "match"))
    first = written(met(asked.where(F.col("place") <= lead)).unionAll(q.join(whole, "text").select("ask", "term")).distinct(), "candidates")
    best = written(top(judged(first)).drop("rank"), "best")
    reached = one_by_one(best).where(F.col("rank") == k).select("ask", F.col("score").alias("least"))
    bound = (NAMES + DEFINITION) * (F.col("a") - lead) / F.col("a")
    open_ = asked.where(F.col("place") > lead).join(reached, "ask", "left").where(F.col("least").isNull() | (F.col("least") <= bound + 1e-9))
    more = judged(met(open_).join(first, ["ask", "term"], "left_anti"))
    found = one_by_one(top(best.unionByName(more)).drop("rank")).join(q, "ask").select("text", "asked", "rank", "iri", "score", "match")
    return every.join(found, ["text", "asked"]).select("qid", "rank", "iri", F.round("score", 4).alias("score"), "match")


def out_of_scope(terms: DataFrame, queries: DataFrame, admissible: DataFrame) -> DataFrame:
    """(qid, out_of_scope_matches): how many terms outside the scope match a query at all.

    Terms that hold the same of the asked items (tokens, and whole labels or synonyms) are one class with a count. A query's items stand from
    the commonest to the rarest; a term is counted at the first of them that it holds. Such beginnings are shared by queries and counted
    once, and the list of a beginning of one item is never read, as its length is known: no pair of a query and a term is stored.
    """
    item = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind), x))
    out = terms.join(admissible.select("iri").distinct(), "iri", "left_anti").select("iri", F.concat(item("t", F.array_union(name_tokens(), tokens(F.col("definition")))), item("h", F.array_compact(heads()))).alias("items"))
    of_term = out.groupBy("iri").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    held = written(of_term.groupBy("items").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.monotonically_increasing_id()), "held")
    text, asked = F.lower(strip(F.col("query"))), item("t", tokens(F.col("query")))
    q = written(queries.select("qid", F.array_compact(F.array_sort(F.array_append(asked, F.concat(F.lit("h"), text)))).alias("asked")), "queries")
    wanted = q.select(F.explode("asked").alias("item")).distinct()
    met = held.select("at", "n", F.explode("items").alias("item")).join(wanted, "item", "left_semi")
    classes = written(met.groupBy("at", "n").agg(F.array_sort(F.collect_list("item")).alias("items")).groupBy("items").agg(F.sum("n").alias("n")).withColumn("at", F.monotonically_increasing_id()), "classes")
    postings = classes.select("at", "n", "items", F.explode("items").alias("item"))
    often = written(postings.groupBy("item").agg(F.sum("n").alias("often")), "often")
    kinds = q.select("asked").distinct()
    line = F.array_sort(F.collect_list(F.struct((-F.col("often")).alias("less"), "item")))
    lines = written(kinds.select("asked", F.explode("asked").alias("item")).join(often, "item").groupBy("asked").agg(line.alias("line")).select("asked", F.col("line.item").alias("line"), F.element_at("line", 1)["less"].alias("less")), "lines")
    begun = written(lines.select("asked", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("line"), F.lit(2))), lambda i: F.slice("line", 1, i))).alias("begun")).where(F.size("begun") > 1), "begun")
    step = begun.select("begun").distinct().withColumn("item", F.element_at("begun", -1)).join(postings, "item")
    first = step.where(~F.arrays_overlap(F.slice("begun", 1, F.size("begun") - 1), F.col("items"))).groupBy("begun").agg(F.sum("n").alias("n"))
    counts = lines.select("asked", (-F.col("less")).alias("n")).unionByName(begun.join(first, "begun").select("asked", "n"))
    n = counts.groupBy("asked").agg(F.sum("n").alias("out_of_scope_matches"))
    return q.join(n, "asked", "left").select("qid", F.coalesce("out_of_scope_matches", F.lit(0)).cast("long").alias("out_of_scope_matches"))


def literal_error(datatype: str, value: object) -> str | None:
    """Why a value is no literal of an XSD type, or None."""
    text = str(value)
    forms = {"integer": r"[+-]?\d+", "decimal": r"[+-]?(\d+(\.\d*)?|\.\d+)", "boolean": r"true|false|1|0", "date": r"-?\d{4}-\d{2}-\d{2}", "string": r"(?s).*"}
    if datatype not in forms:
        return f"unknown datatype {datatype!r}"
    if isinstance(value, bool) and datatype != "boolean" or not re.fullmatch(forms[datatype], text.lower() if isinstance(value, bool) else text):
        return "datatype_mismatch"
    if datatype == "date":
        import datetime

        try:
            datetime.date.fromisoformat(text)
        except ValueError:
            return "datatype_mismatch"
    return None


def validate_mapping(mapping: Sequence[Mapping], fields: Mapping[str, Field], verdicts: Mapping[tuple[str, str], str]) -> list[dict]:
    """Error codes per decision {field, decision, values, reason}; ``verdicts`` holds the scope of (field, iri)."""
    out = []
    for i, m in enumerate(mapping):
        codes = []
        values = m.get("values") or []
        if not isinstance(m, Mapping) or "field" not in m or "decision" not in m:
            codes.append("malformed")
        elif m["field"] not in fields:
            codes.append("unknown_field")
        elif m["decision"] not in ("mapped", "abstain"):
            codes.append("unknown_decision")
        elif m["decision"] == "abstain":
            codes += ["value_with_abstention"] * bool(values) + ["missing_reason"] * (not m.get("reason"))
        else:
            codes += ["null_value"] * any(v is None for v in values) + ["cardinality_violation"] * (len(values) != 1)
            for v in values:
                if v is not None and "://" not in str(v):
                    codes.append("label_not_iri")
                elif v is not None and (state := verdicts.get((m["field"], v), "unknown_iri")) != "admissible":
                    codes.append(state)
        out.append({"index": i, "errors": codes, "valid": not codes})
    return out


# The forms of the XSD types that literals may have.
LITERALS = {"integer": r"^[+-]?\d+$", "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$", "boolean": r"^(true|false|1|0)$", "date": r"^-?\d{4}-\d{2}-\d{2}$", "string": r"(?s)^.*$"}


def constraints(fields: Mapping[str, Field], name: str | None = None) -> list[dict[str, object]]:
    """What each field, or the one named, admits."""
    if name is not None and name not in fields:
        raise QueryLookupError(f"unknown field {name!r}; available: {sorted(fields)}")
    return [{"field": k, "value_type": "literal" if f.datatype else "term"} | dataclasses.asdict(f) for k, f in sorted(fields.items()) if name in (None, k)]


def term_context(terms: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(iri, label, parents, children) of the terms asked for (column iri); an unknown one has a null label. Lists are as long as
    the term's own edges."""
    up = edges.join(asked.select(F.col("iri").alias("node")), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    down = edges.join(asked.select(F.col("iri").alias("parent")), "parent", "left_semi").groupBy("parent").agg(F.array_sort(F.collect_set("node")).alias("children"))
    none = F.array().cast("array<string>")
    out = asked.select("iri").distinct().join(terms.select("iri", "label"), "iri", "left").join(up.withColumnRenamed("node", "iri"), "iri", "left").join(down.withColumnRenamed("parent", "iri"), "iri", "left")
    return out.select("iri", "label", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def literal_fits(datatype: Column, value: Column) -> Column:
    """Whether a text is a literal of the XSD type; dates must exist."""
    out = F.lit(False)
    for kind, form in LITERALS.items():
        fits = value.rlike(form)
        out = F.when(datatype == kind, fits & F.try_to_date(value, "yyyy-MM-dd").isNotNull() if kind == "date" else fits).otherwise(out)
    return F.coalesce(out, F.lit(False))


def validate(rows: DataFrame, fields: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, codes): what is wrong with each decision (id, field, decision, values, reason), none if it is sound.

    ``fields`` is (field, datatype); a datatype makes the field literal. ``verdicts`` is (field, iri, verdict) as ``scope`` gives it;
    an iri without one is unknown. Both meet the decisions in joins by key, so a mapping may have any number of rows.
    """
    known = rows.join(fields.select("field", F.col("datatype"), F.lit(True).alias("known")), "field", "left")
    empty = F.array().cast("array<string>")
    held = known.withColumn("values", F.coalesce("values", empty))
    one = held.select("id", "field", "datatype", F.explode("values").alias("value")).join(verdicts.withColumnRenamed("iri", "value"), ["field", "value"], "left")
    literal = F.col("datatype").isNotNull()
    url = F.col("value").contains("://")
    code = F.when(F.col("value").isNull(), "null_value").when(literal & ~literal_fits(F.col("datatype"), F.col("value")), "datatype_mismatch").when(literal, None)
    code = code.when(~url & F.col("value").rlike(r"^[+-]?[0-9.]+$"), "literal_not_allowed").when(~url, "label_not_iri").when(F.coalesce("verdict", F.lit("unknown_iri")) != "admissible", F.coalesce("verdict", F.lit("unknown_iri")))
    per_value = one.groupBy("id").agg(F.array_sort(F.collect_set(code)).alias("value_codes"))
    out = held.join(per_value, "id", "left")
    bad = F.col("field").isNull() | F.col("decision").isNull()
    mapped, abstain = F.col("decision") == "mapped", F.col("decision") == "abstain"
    part = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(empty)
    told = F.when(bad, F.array(F.lit("malformed"))).when(F.col("known").isNull(), F.array(F.lit("unknown_field"))).when(~(mapped | abstain), F.array(F.lit("unknown_decision")))
    told = told.when(abstain, F.concat(part(F.size("values") > 0, "value_with_abstention"), part(F.coalesce(F.trim("reason"), F.lit("")) == "", "missing_reason")))
    told = told.otherwise(F.concat(part(F.size("values") != 1, "cardinality_violation"), F.coalesce("value_codes", empty)))
    return out.select("id", told.alias("codes"))


def faithful(record: DataFrame, source: DataFrame) -> DataFrame:
    """(field, value, fault): entries of a semantic record whose value the source does not hold in that field; such a record is
    rejected as a whole."""
    return record.join(source.select("field", "value").distinct(), ["field", "value"], "left_anti").select("field", "value", F.lit("not_in_source").alias("fault"))


def compile_terms(documents: DataFrame, column: str = "value") -> DataFrame:
    """Terms (iri, ontology, kind, label, synonyms, definition, parents, deprecated) from JSON documents, each a list of terms.
    A term without iri or label, or an iri that two terms claim, stops the job."""
    shape = "array<struct<iri:string,ontology:string,kind:string,label:string,synonyms:array<string>,definition:string,parents:array<string>,deprecated:boolean>>"
    terms = documents.select(F.explode(F.from_json(column, shape)).alias("t")).select("t.*")
    lacking = F.when(F.coalesce(F.trim("iri"), F.lit("")) == "", F.raise_error(F.lit("a term has no iri")).cast("string")).when(F.coalesce(F.trim("label"), F.lit("")) == "", F.raise_error(F.concat(F.lit("no label: "), F.col("iri"))).cast("string"))
    terms = terms.withColumn("iri", F.coalesce(lacking, F.col("iri")))
    claims = terms.groupBy("iri").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*[c for c in terms.columns if c != "iri"])).alias("t"))
    twice = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two terms claim "), F.col("iri"))).cast("string"))
    return claims.select(F.coalesce(twice, F.col("iri")).alias("iri"), "t.*").withColumn("kind", F.coalesce("kind", F.lit("class"))).withColumn("deprecated", F.coalesce("deprecated", F.lit(False)))


def exact_matches(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(value, status, iri): a raw value maps where exactly one term has it as label or synonym, in any case."""
    names = terms.select("iri", F.explode(F.array_distinct(F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("label")))).alias("name")).select("iri", F.lower(F.trim("name")).alias("name")).distinct()
    asked = values.select("value", F.lower(F.trim("value")).alias("name")).distinct()
    met = asked.join(names, "name", "left").groupBy("value").agg(F.count("iri").alias("k"), F.min("iri").alias("iri"))
    return met.select("value", F.when(F.col("k") == 0, "unresolved").when(F.col("k") == 1, "mapped").otherwise("ambiguous").alias("status"), F.when(F.col("k") == 1, F.col("iri")).alias("iri"))


def undefined_terms(used: DataFrame, defined: DataFrame) -> DataFrame:
    """Terms that data use and no vocabulary of their namespace defines."""
    return used.select("namespace", "term").distinct().join(defined.select("namespace", "term"), ["namespace", "term"], "left_anti")


def ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(subject, predicate, object) from N-Triples lines; comments and blank lines drop out."""
    rx = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(.+?)\s*\.\s*(?:#.*)?$"
    c = F.col(column)
    return lines.where(c.rlike(rx)).select(*[F.regexp_extract(c, rx, i).alias(n) for i, n in ((1, "subject"), (2, "predicate"), (3, "object"))])
