"""Registered queries: each function of the library over whole tables, with its SQL on the plain ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage import sql as packed_sql
from stowage.codec import RAW, dictionary_id
from stowage.functions import documents as D
from stowage.functions import packing as P
from stowage.operators import analyze as A
from stowage.operators import relational as R
from stowage.registry import Registry, train_dictionary
from stowage.session import prepared, read_table, shared_dir, spread
from stowage.sources import tables as T
from stowage.streaming.replicate import replicate
from stowage.sync import sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_registries: dict[tuple[str, str], Registry] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(prepared(spark), sf_dir)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def trained(spark: SparkSession, sf_dir: str) -> Registry:
    """A registry with a dictionary 'documents', trained on a bounded sample of the table, in slot 1."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _registries:
        registry = Registry(spark, fresh(spark, "registry"))
        docs = read_table(spark, sf_dir, "documents").where("text is not null").orderBy(F.xxhash64("doc_id")).limit(2000)
        registry.add("documents", train_dictionary(docs.select("text"), 8192), "documents")
        _registries[key] = registry
    return _registries[key]


def docs_of(spark, sf_dir, policy="(6)", registry=None) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    return docs.withColumn("body", P.pack_text("text", policy, registry)).drop("text")


def lines_of(spark, sf_dir) -> DataFrame:
    """lineitem rows as packed order-line documents, with the columns they are made of."""
    items = spread(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))
    document = F.to_json(F.struct("l_orderkey", "l_linenumber", "l_returnflag", F.array("l_returnflag", "l_linestatus").alias("tags"), F.struct(F.col("l_partkey").alias("k"), F.lit("order line").alias("note")).alias("nest")))
    return items.withColumn("doc", P.pack_json(document, "(1)"))


@query("select lang, count(*) as n, sum(strlen(text))::bigint as raw_bytes, count(*) filter (strlen(text) < 64) as n_short from documents group by lang")
def packed_header_report(spark, sf_dir):
    """The flagship: documents packed, written, and reported on from their headers alone."""
    path = fresh(spark, "packed")
    docs_of(spark, sf_dir).select("lang", "body").write.parquet(path)
    c = F.col("body")
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum(P.raw_length(c).cast("long")).alias("raw_bytes"), F.count_if((c["codec"] == 0) & (c["rawlen"] < 64)).alias("n_short"))


@query("select doc_id, text from documents")
def roundtrip_text(spark, sf_dir):
    registry = trained(spark, sf_dir)
    return docs_of(spark, sf_dir, "(6,documents)", registry).select("doc_id", P.unpack("body", "text", registry).alias("text"))


@query("select event_id, props from events")
def roundtrip_json(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", P.pack_json("props", "(6)").alias("p"))
    return events.select("event_id", P.unpack("p", "json").alias("props"))


@query("select doc_id, md5(text) as digest, strlen(text)::integer as raw_bytes from documents")
def roundtrip_bytes(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", P.pack_bytes(F.col("text").cast("binary"), "(1)").alias("b"))
    return docs.select("doc_id", F.md5(P.unpack("b", "bytes")).alias("digest"), P.raw_length("b").alias("raw_bytes"))


@query("select doc_id, left(text, list_max(list_filter(range(0, 101), lambda k: strlen(left(text, k)) <= 100))::integer) as head from documents")
def prefix_of_text(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", P.prefix("body", 100).alias("head"))


@query("select text, 2 * count(*) as n from documents group by text")
def group_across_policies(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("text")
    both = docs.select(P.pack_text("text", "(1)").alias("body")).unionByName(docs.select(P.pack_text("text", "(9)").alias("body")))
    grouped = R.group_packed(both, {"body": "text"}, F.count("*").alias("n"))
    return grouped.select(P.unpack("body").alias("text"), "n")


@query("select distinct role, text from conversations")
def distinct_rows(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select("role", P.pack_text("text").alias("body"))
    return R.distinct_packed(rows, {"body": "text"}).select("role", P.unpack("body").alias("text"))


def _halves(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    half = lambda n, p: docs.where(F.col("doc_id") % 2 == n).select(P.pack_text("text", p).alias("body"))
    return half(0, "(1)"), half(1, "(6)")


_HALVES = "with a as (select text from documents where doc_id % 2 = 0), b as (select text from documents where doc_id % 2 = 1) "


@query(_HALVES + "select text from a union select text from b")
def union_rows(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return R.union_packed(a, b, {"body": "text"}).select(P.unpack("body").alias("text"))


@query(_HALVES + "select text from a intersect select text from b")
def intersect_rows(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return R.intersect_packed(a, b, {"body": "text"}).select(P.unpack("body").alias("text"))


@query(_HALVES + "select text from a except select text from b")
def except_rows(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return R.except_packed(a, b, {"body": "text"}).select(P.unpack("body").alias("text"))


@query("with g as (select text, count(*) as n, min(doc_id) as first_id from documents group by text) select doc_id, n, first_id from documents join g using (text)")
def join_across_policies(spark, sf_dir):
    docs = docs_of(spark, sf_dir, "(1)").select("doc_id", "body")
    grouped = R.group_packed(docs_of(spark, sf_dir, "(9)").select(F.col("doc_id").alias("i"), F.col("body").alias("other")), {"other": "text"}, F.count("*").alias("n"), F.min("i").alias("first_id"))
    return R.join_packed(docs, grouped, "body", "other").select("doc_id", "n", "first_id")


@query("select doc_id from documents where text in (select text from documents where source = 'src1')")
def semi_join(spark, sf_dir):
    docs = docs_of(spark, sf_dir, "(1)")
    return R.join_packed(docs, docs_of(spark, sf_dir, "(6)").where("source = 'src1'").select(F.col("body").alias("other")), "body", "other", how="left_semi").select("doc_id")


@query("select doc_id from documents where text not in (select text from documents where source = 'src1')")
def anti_join(spark, sf_dir):
    docs = docs_of(spark, sf_dir, "(1)")
    return R.join_packed(docs, docs_of(spark, sf_dir, "(6)").where("source = 'src1'").select(F.col("body").alias("other")), "body", "other", how="left_anti").select("doc_id")


@query("select n_nationkey from nation where n_name in ('NATION_1', 'NATION_7', 'FRANCE', 'CHINA')")
def in_list(spark, sf_dir):
    nations = read_table(spark, sf_dir, "nation").withColumn("name", P.pack_text("n_name"))
    return R.in_packed(nations, "name", ["NATION_1", "NATION_7", "FRANCE", "CHINA"]).select("n_nationkey")


@query("select text from (select distinct text from documents) order by text desc limit 20")
def sort_and_limit(spark, sf_dir):
    rows = R.distinct_packed(docs_of(spark, sf_dir).select("body"), {"body": "text"})
    return R.sort_unpacked(rows, "body", descending=True, limit=20).select(P.unpack("body").alias("text"))


@query("select count(distinct text) as n from documents")
def count_distinct_values(spark, sf_dir):
    return R.count_distinct_packed(docs_of(spark, sf_dir), "body")


@query("select lang, text, row_number() over (partition by lang, text order by doc_id) as copy_no, doc_id from documents")
def window_by_value(spark, sf_dir):
    docs = docs_of(spark, sf_dir).withColumn("text", R.window_key("body"))
    return docs.select("lang", "text", F.row_number().over(Window.partitionBy("lang", "text").orderBy("doc_id")).alias("copy_no"), "doc_id")


@query("select r_name as region, n_regionkey::varchar as k, count(*) as n from nation join region on n_regionkey = r_regionkey group by rollup (r_name, n_regionkey)")
def rollup_by_value(spark, sf_dir):
    rows = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    packed = rows.select(P.pack_text("r_name").alias("region"), P.pack_text(F.col("n_regionkey").cast("string")).alias("k"))
    out = R.grouping_sets_packed(packed, {"region": "text", "k": "text"}, F.count("*").alias("n"))
    return out.select("region", "k", "n")


@query("select doc_id, true as same, true as seeded from documents")
def hash_of_value(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", P.pack_text("text", "(3)").alias("body"))
    return docs.select("doc_id", (P.packed_hash("body") == F.xxhash64("text")).alias("same"), (P.packed_hash("body", seed=5) == F.xxhash64(F.lit(5).cast("long"), "text")).alias("seeded"))


@query("select event_id, true as same_text, false as other_text, true as same_json, false as other_json from events")
def equality_of_values(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    number = F.format_string("%.2f", F.col("event_id").cast("double"))
    e = e.select(
        "event_id", P.pack_text(F.repeat("event_type", 40), "(1)").alias("a"), P.pack_text(F.repeat("event_type", 40), "(9)").alias("b"), P.pack_text(F.repeat("event_type", 41)).alias("c"),
        P.pack_json(F.concat(F.lit('{"a": '), number, F.lit(', "b": 1.0}')), "(1)").alias("x"), P.pack_json(F.concat(F.lit('{"b": 1.00, "a": '), F.col("event_id").cast("string"), F.lit("}")), "(9)").alias("y"),
        P.pack_json(F.concat(F.lit('{"b": 1.01, "a": '), F.col("event_id").cast("string"), F.lit("}"))).alias("z"),
    )
    eq = P.packed_eq
    return e.select("event_id", eq("a", "b").alias("same_text"), eq("a", "c").alias("other_text"), eq("x", "y", "json").alias("same_json"), (~P.packed_ne("x", "z", "json")).alias("other_json"))


@query("""select l_orderkey, l_linenumber, '"' || l_returnflag || '"' as flag, l_returnflag as flag_text, l_orderkey::varchar as order_text, null::varchar as missing from lineitem""")
def json_by_key(spark, sf_dir):
    return lines_of(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", D.json_field("doc", "l_returnflag").alias("flag"), D.json_field_text("doc", "l_returnflag").alias("flag_text"),
        D.json_field_text("doc", "l_orderkey").alias("order_text"), D.json_field("doc", "none").alias("missing"),
    )


@query("""select l_orderkey, l_linenumber, '["' || l_returnflag || '", "' || l_linestatus || '"]' as tags, '"' || l_linestatus || '"' as last_tag, l_returnflag as first_tag, l_partkey::varchar as nested, l_linestatus as by_path
          from lineitem""")
def json_by_position_and_path(spark, sf_dir):
    items = lines_of(spark, sf_dir)
    tags = P.pack_json(D.json_field("doc", "tags"))
    items = items.withColumn("tags", tags)
    return items.select(
        "l_orderkey", "l_linenumber", P.unpack("tags", "json").alias("tags"), D.json_element("tags", -1).alias("last_tag"), D.json_element_text("tags", 0).alias("first_tag"),
        D.json_path_text("doc", ["nest", "k"]).alias("nested"), D.json_path_text("doc", ["tags", "1"]).alias("by_path"),
    )


@query("""select l_orderkey, l_linenumber, true as has_key, false as has_none, true as has_any, true as has_all, l_returnflag = 'N' as holds, l_linenumber = 1 as held,
                 l_returnflag = 'R' as tagged from lineitem""")
def json_existence_and_containment(spark, sf_dir):
    held = '{"l_linenumber": 1.0, "x": 1}'
    items = lines_of(spark, sf_dir).withColumn("small", P.pack_json(F.format_string('{"l_linenumber": %d}', "l_linenumber")))
    return items.select(
        "l_orderkey", "l_linenumber", D.json_has("doc", "nest").alias("has_key"), D.json_has("doc", "k").alias("has_none"), D.json_has_any("doc", ["x", "tags"]).alias("has_any"),
        D.json_has_all("doc", ["l_orderkey", "tags"]).alias("has_all"), D.json_contains("doc", '{"l_returnflag": "N", "nest": {}}').alias("holds"),
        D.json_contained("small", held).alias("held"), D.json_contains("doc", '{"tags": ["R"]}').alias("tagged"),
    )


@query("""select l_orderkey, l_linenumber, l_partkey > 100 as found, l_linenumber + 1 > 3 and l_linestatus = 'O' as matched, null::boolean as no_answer from lineitem""")
def json_path_queries(spark, sf_dir):
    return lines_of(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", D.jsonpath_exists("doc", "$.nest.k ? (@ > 100)").alias("found"), D.jsonpath_match("doc", '$.l_linenumber + 1 > 3 && $.tags[last] == "O"').alias("matched"),
        D.jsonpath_match("doc", "$.nest").alias("no_answer"),
    )


@query("select l_returnflag as flag, l_linestatus as status, count(*) as n, sum(l_partkey)::bigint as parts from lineitem group by all")
def json_extract_and_group(spark, sf_dir):
    paths = {"flag": ["l_returnflag"], "status": ["tags", "1"], "part": ["nest", "k"]}
    rows = lines_of(spark, sf_dir).select(D.json_extract("doc", paths).alias("x")).select("x.*")
    return rows.groupBy("flag", "status").agg(F.count("*").alias("n"), F.sum(F.col("part").cast("long")).alias("parts"))


@query("select 'text' as kind, case when strlen(text) < 64 then 'short' else 'long' end as size, 6 as level, count(*) as n, sum(strlen(text))::bigint as raw_bytes from documents group by all")
def inspect_headers(spark, sf_dir):
    registry = trained(spark, sf_dir)
    rows = A.inspect_packed(docs_of(spark, sf_dir, "(6,documents)", registry).select("body"), "body", registry).select("inspected.*")
    size = F.when(F.col("raw_length") < 64, "short").otherwise("long")
    return rows.groupBy("kind", size.alias("size"), "level").agg(F.count("*").alias("n"), F.sum(F.col("raw_length").cast("long")).alias("raw_bytes"))


@query("select doc_id, true as at_six, false as at_nine, text is not null as stored_rightly from documents")
def matches_policy_headers(spark, sf_dir):
    """stored_rightly: short values raw, and a dictionary in the header just where the value is no raw one.
    Which of the longer values zstd makes shorter SQL can't say; a test holds that against frames made
    one by one."""
    registry = trained(spark, sf_dir)
    docs = docs_of(spark, sf_dir, "(6,documents)", registry)
    raw, length = F.col("codec") == RAW, F.col("rawlen")
    found = _matches(docs, registry, docs["body"]["codec"].alias("codec"), docs["body"]["rawlen"].alias("rawlen"))
    return found.select("doc_id", "at_six", "at_nine", (raw.eqNullSafe(F.col("no_dictionary")) & (raw | (length >= 64))).alias("stored_rightly"))


def _matches(docs: DataFrame, registry: Registry, *more) -> DataFrame:
    c = docs["body"]
    return docs.select("doc_id", *more, P.matches_policy(c, 6, 1, registry).alias("at_six"), P.matches_policy(c, 9, 1, registry).alias("at_nine"), P.dictionary_id_of(c).isNull().alias("no_dictionary"))


@query("select doc_id, text, 9 as level, true as settled, text as again from documents")
def coerce_and_recompress(spark, sf_dir):
    registry = trained(spark, sf_dir)
    docs = docs_of(spark, sf_dir, "(6,documents)", registry).withColumn("moved", P.coerce("body", "(9)", registry)).withColumn("new", P.recompress("moved", 3, 1, registry))
    return docs.select(
        "doc_id", P.unpack("moved", "text", registry).alias("text"), F.col("moved.level").cast("int").alias("level"),
        (P.matches_policy("moved", 9) & P.dictionary_id_of("moved").isNull()).alias("settled"), P.unpack("new", "text", registry).alias("again"),
    )


@query("select doc_id, text, text as portable, text as base from documents")
def frame_output(spark, sf_dir):
    registry = trained(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", P.pack_text("text", "(6,documents)", registry).alias("body"))
    plain = lambda c, r=None: P.read_frame(c, r).cast("string")
    return docs.select(
        "doc_id", plain(P.frame("body", False, registry), registry).alias("text"), plain(P.frame("body", True, registry)).alias("portable"), plain(P.frame_of("text", 3)).alias("base"),
    )


_VERDICTS = """select doc_id, null::varchar as clean, 'invalid or unsupported storage format' as magic, 'invalid value header' as kind, 'invalid value header' as level,
               case when strlen(text) < 64 then 'invalid raw value length' end as short_length, true as length_found from documents"""


@query(_VERDICTS)
def validate_sweep(spark, sf_dir):
    """A sweep over values and broken copies of them; nothing raises. A wrong length is found in values of
    all sizes; of short ones, which are raw, the words are known too. A test holds all words against
    frames made one by one."""
    found = _sweep(docs_of(spark, sf_dir, "(6)").withColumn("bytes", F.col("body.rawlen")), "bytes")
    known = F.col("length").isin("invalid raw value length", "invalid frame header")
    return found.select("doc_id", "clean", "magic", "kind", "level", F.when(F.col("bytes") < 64, F.col("length")).alias("short_length"), known.alias("length_found"))


def _sweep(docs: DataFrame, *more: str) -> DataFrame:
    """A null value has no broken copies: all its verdicts are null."""
    broken = {"clean": {}, "magic": {"magic": F.lit(1)}, "kind": {"kind": F.lit(3).cast("tinyint")}, "level": {"level": F.lit(23).cast("tinyint")}, "length": {"rawlen": F.col("body.rawlen") + 1}}
    copies = docs.select("doc_id", *more, *[F.when(F.col("body").isNotNull(), F.struct(*[change.get(n, F.col("body")[n]).alias(n) for n in P.LEAVES])).alias(name) for name, change in broken.items()])
    return copies.select("doc_id", *more, *[P.validate(name, "text").alias(name) for name in broken])


@query("select event_id, case when event_id % 3 = 0 then null else props end as props, event_id % 3 = 0 as refused from events")
def tolerant_ingest(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    rows = events.select("event_id", P.try_pack_json(line).alias("r"))
    return rows.select("event_id", P.unpack(F.col("r.value"), "json").alias("props"), F.col("r.problem").isNotNull().alias("refused"))


@query("select event_id, props, 5 as level from events where event_id % 3 <> 0")
def file_ingest(spark, sf_dir):
    """Files of JSON lines into a packed table, less the rows whose document is broken."""
    events = read_table(spark, sf_dir, "events")
    props = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    lines = fresh(spark, "lines")
    events.select(F.to_json(F.struct("event_id", props.alias("props"))).alias("line")).write.text(lines)
    table = T.PackedTable(spark, fresh(spark, "ingested"))
    table.ingest(lines, "event_id long, props string", "json", "ignore", {"props": ("json", "(5)")})
    stored = table.read()
    return stored.select("event_id", P.unpack(stored["props"], "json").alias("props"), stored["props"]["level"].cast("int").alias("level"))


def _table(spark, sf_dir, policy, registry) -> T.PackedTable:
    table = T.PackedTable(spark, fresh(spark, "table"), registry)
    table.write(read_table(spark, sf_dir, "documents").select("doc_id", "text"), {"text": ("text", policy)})
    return table


@query("""select 1 as step, 'behind' as what, count(*) as n from documents where strlen(text) >= 0 union all select 2, 'caught up', count(*) from documents
          union all select 3, 'behind', 0 union all select 4, 'finished', 1 union all select 5, 'values', count(distinct text) from documents""")
def policy_lifecycle(spark, sf_dir):
    """set, catch up, finish; then the values are what they were."""
    table = _table(spark, sf_dir, "(3)", trained(spark, sf_dir))
    table.set_policy("text", 9)
    steps = [(1, "behind", table.behind("text").count()), (2, "caught up", table.catch_up("text")), (3, "behind", table.behind("text").count()), (4, "finished", int(table.finish_policy("text")))]
    values = table.logical().agg(F.count_distinct("text").alias("n")).select(F.lit(5).alias("step"), F.lit("values").alias("what"), "n")
    return spark.createDataFrame(steps, "step int, what string, n long").union(values)


@query("select doc_id, text from documents")
def table_export(spark, sf_dir):
    table = _table(spark, sf_dir, "(6,documents)", trained(spark, sf_dir))
    table.repack("text", "(9)")
    return table.logical()


@query("select * from (values ('bare', 'text', 'text', false, 6, 0, false), ('named', 'text', 'text', true, 9, 1, false), ('pending', 'text', 'text', true, 3, 0, true)) as t(\"table\", \"column\", kind, has_policy, level, slot, pending)")
def column_policy_list(spark, sf_dir):
    registry = trained(spark, sf_dir)
    tables = {"bare": _table(spark, sf_dir, None, registry), "named": _table(spark, sf_dir, "(9,documents)", registry), "pending": _table(spark, sf_dir, "(6)", registry)}
    tables["pending"].set_policy("text", 3)
    return T.column_policies(tables, registry).select("table", "column", "kind", "has_policy", "level", "slot", "pending")


@query("select * from (values ('a', 'text', 'different level, no dictionary here'), ('b', 'text', 'no dictionary here'), ('c', 'text', 'dictionary here, none on the publisher')) as t(\"table\", \"column\", difference)")
def policy_difference_list(spark, sf_dir):
    registry = trained(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").select("text").limit(0)

    def made(policy):
        table = T.PackedTable(spark, fresh(spark, "table"), registry)
        table.write(docs, {"text": ("text", policy)})
        return table

    here = T.column_policies({"a": made("(3)"), "b": made("(6)"), "c": made("(6,1)"), "d": made("(6)")}, registry)
    there = T.column_policies({"a": made("(6,1)"), "b": made("(6,1)"), "c": made("(6)"), "d": made("(6)")}, registry)
    return T.policy_differences(here, there)


@query("""select count(*) as n_rows, 0.0::double as null_fraction, (count(distinct case when strlen(text) <= 1024 then text end) + count(*) filter (strlen(text) > 1024)) as n_distinct,
          least(100, (select count(*) from (select text from documents where strlen(text) <= 1024 group by text having count(*) > 1))) as n_most_common from documents""")
def analyze_column(spark, sf_dir):
    return A.analyze_packed(docs_of(spark, sf_dir).select("body"), "body").select("n_rows", "null_fraction", "n_distinct", "n_most_common")


@query("select text as value, count(*) as n from documents where strlen(text) <= 1024 group by text having count(*) > 1 order by n desc, text limit 100")
def most_common_values(spark, sf_dir):
    return A.most_common_values(docs_of(spark, sf_dir).select("body"), "body")


@query("select text as value, count(*) as n, 9 as level from documents where strlen(text) <= 1024 group by text having count(*) > 1 order by n desc, text limit 100")
def most_common_values_packed(spark, sf_dir):
    top = A.most_common_values(docs_of(spark, sf_dir).select("body"), "body", policy="(9)")
    return top.select(P.unpack("value").alias("value"), "n", F.col("value.level").cast("int").alias("level"))


@query("select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'")
def partition_pruning(spark, sf_dir):
    path = fresh(spark, "parts")
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", P.pack_text("c_mktsegment").alias("segment"))
    keyed, (key,) = R.with_keys(rows, {"segment": "text"})
    T.partitioned_write(keyed, key, path, 8)
    return T.partitioned_read(spark, path, key, "BUILDING", 8).select("c_custkey", P.unpack("segment").alias("c_mktsegment"))


@query("select conv_id, turn, role, text from conversations")
def stream_copy(spark, sf_dir):
    """A stream of packed rows, replicated under another policy."""
    registry = trained(spark, sf_dir)
    source, copy = T.PackedTable(spark, fresh(spark, "source"), registry), T.PackedTable(spark, fresh(spark, "copy"), registry)
    rows = read_table(spark, sf_dir, "conversations")
    source.write(rows, {"text": ("text", "(6,documents)")})
    copy.write(rows.limit(0), {"text": ("text", "(3)")})
    held = source.read()
    stream = spark.readStream.schema(held.schema).parquet(source._held()["data"])
    replicate(stream, copy, fresh(spark, "progress"), registry, {"text": "text"}).awaitTermination()
    return copy.logical()


@query("select lang, sum(strlen(text))::bigint as raw_bytes, count(*) filter (text like '%the%') as n_the, 0::bigint as n_bad from documents group by lang")
def sql_functions(spark, sf_dir):
    packed_sql.register(spark)
    read_table(spark, sf_dir, "documents").select("lang", P.pack_text("text").alias("body")).createOrReplaceTempView("packed_documents")
    return spark.sql("select lang, sum(cast(raw_length(body) as bigint)) as raw_bytes, count_if(t like '%the%') as n_the, count(bad) as n_bad from (select lang, body, unpack_text(body) as t, validate_text(body) as bad from packed_documents) group by lang")


@query("select lang, 'missing' as checked, 'imported' as synced, 'present' as again, 2 as code_checked, 0 as code_synced, 0 as code_again from documents group by lang having count(*) >= 8")
def registry_sync(spark, sf_dir):
    """A dictionary for each language brought into an empty registry: what the command says and returns."""
    docs, source, target = read_table(spark, sf_dir, "documents"), Registry(spark, fresh(spark, "registry")), Registry(spark, fresh(spark, "registry"))
    for r in docs.groupBy("lang").count().where("count >= 8").orderBy("lang").collect():
        source.add(r["lang"], train_dictionary(docs.where(F.col("lang") == r["lang"]).orderBy("doc_id").select("text"), 2048))
    said, codes = [], []
    for options in ({"check": True}, {}, {}):
        lines: list[str] = []
        codes.append(sync(source, target, say=lines.append, **options))
        said.append({x.rsplit(": ", 1)[1]: x.split()[0] for x in lines if ": " in x})
    rows = [(name, *(s.get(name) for s in said), *codes) for name in said[1]]
    return spark.createDataFrame(rows, "lang string, checked string, synced string, again string, code_checked int, code_synced int, code_again int")


@query("select event_id, props, 9 as level, 3 as again, true as on_policy, false as off_policy from events")
def json_under_policies(spark, sf_dir):
    """Packed JSON coerced to a policy and recompressed, and what its headers say of policies."""
    rows = read_table(spark, sf_dir, "events").select("event_id", P.pack_json("props", "(6)").alias("p"))
    rows = rows.withColumn("moved", P.coerce("p", "(9)")).withColumn("new", P.recompress("moved", 3))
    return rows.select(
        "event_id", P.unpack("new", "json").alias("props"), F.col("moved.level").cast("int").alias("level"), F.col("new.level").cast("int").alias("again"),
        P.matches_policy("moved", 9).alias("on_policy"), P.matches_policy("moved", 6).alias("off_policy"),
    )


@query("select doc_id, md5(text) as digest, 2 as level, 3 as again, case when text is not null then true end as on_policy, case when text is not null then false end as off_policy from documents where text is not null")
def bytes_under_policies(spark, sf_dir):
    """Packed bytes coerced to a policy and recompressed with a dictionary, and what their headers say."""
    registry = trained(spark, sf_dir)
    rows = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", P.pack_bytes(F.col("text").cast("binary"), "(6,documents)", registry).alias("b"))
    rows = rows.withColumn("moved", P.coerce("b", "(2)", registry)).withColumn("new", P.recompress("moved", 3, 1, registry))
    return rows.select(
        "doc_id", F.md5(P.unpack("new", "bytes", registry)).alias("digest"), F.col("moved.level").cast("int").alias("level"), F.col("new.level").cast("int").alias("again"),
        P.matches_policy("new", 3, 1, registry).alias("on_policy"), P.matches_policy("moved", 6, 1, registry).alias("off_policy"),
    )


@query("""select 'json' as kind, 1 as format, 4 as level, count(*) as n, sum(strlen(props))::bigint as raw_bytes from events
          union all select 'bytes', 0, 5, count(*), sum(strlen(text))::bigint from documents where text is not null""")
def inspect_json_and_bytes(spark, sf_dir):
    registry = trained(spark, sf_dir)
    events = read_table(spark, sf_dir, "events").select(P.pack_json("props", "(4)").alias("v"))
    docs = read_table(spark, sf_dir, "documents").where("text is not null").select(P.pack_bytes(F.col("text").cast("binary"), "(5,documents)", registry).alias("v"))
    parts = [A.inspect_packed(df, "v", registry).select("inspected.*") for df in (events, docs)]
    return parts[0].unionByName(parts[1]).groupBy("kind", "format", "level").agg(F.count("*").alias("n"), F.sum(F.col("raw_length").cast("long")).alias("raw_bytes"))


@query("select doc_id, left(text, 7) as head, md5(text) as moved, md5(text) as framed, 'text' as kind, 3 as level, true as same, false as other, true as hashed, true as on_policy, true as any_key, false as all_keys from documents where text is not null and strlen(left(text, 7)) = 7")
def more_sql_functions(spark, sf_dir):
    registry = trained(spark, sf_dir)
    packed_sql.register(spark, registry)
    read_table(spark, sf_dir, "documents").where("text is not null and octet_length(left(text, 7)) = 7").select("doc_id", "text").createOrReplaceTempView("plain_documents")
    return spark.sql("""
        select doc_id, packed_prefix(body, 7) as head, md5(unpack_text(moved)) as moved, md5(unpack_text(pack_text_slot(cast(read_frame(frame_packed(body, true)) as string), 5, 0))) as framed,
               i.kind, i.level, packed_eq_text(body, moved) as same, packed_ne_text(body, moved) as other, packed_hash_text(moved) = xxhash64(text) as hashed,
               packed_matches_policy(moved, 3, 0) as on_policy, json_has_any(j, array('x', 'a')) as any_key, json_has_all(j, array('x', 'a')) as all_keys
        from (select *, inspect_packed(moved) as i from (select doc_id, text, body, coerce_packed(body, 3, 0) as moved, pack_json('{"a": 1}', 1) as j
              from (select doc_id, text, pack_text_slot(text, 6, 1) as body from plain_documents)))""")


@query("""select event_id, null::varchar as clean, 'unsupported JSON payload format 0' as format, 'invalid value header' as kind, 'invalid value header' as as_text,
                 null::varchar as clean_bytes, 'invalid value header' as bytes_format, 'invalid raw value length' as bytes_length from events""")
def validate_json_and_bytes(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    rows = events.select("event_id", P.pack_json("props").alias("p"), P.pack_bytes(F.substring(F.md5("props"), 1, 9).cast("binary")).alias("b"))
    broken = lambda c, **change: F.struct(*[change.get(n, F.col(c)[n]).alias(n) for n in P.LEAVES])
    rows = rows.select(
        "event_id", "p", "b", broken("p", format=F.lit(0).cast("tinyint")).alias("q"), broken("p", kind=F.lit(1).cast("tinyint")).alias("k"),
        broken("b", format=F.lit(1).cast("tinyint")).alias("f"), broken("b", rawlen=F.col("b.rawlen") + 1).alias("n"),
    )
    return rows.select(
        "event_id", P.validate("p", "json").alias("clean"), P.validate("q", "json").alias("format"), P.validate("k", "json").alias("kind"), P.validate("p", "text").alias("as_text"),
        P.validate("b", "bytes").alias("clean_bytes"), P.validate("f", "bytes").alias("bytes_format"), P.validate("n", "bytes").alias("bytes_length"),
    )


@query("select doc_id, md5(text) as stored, md5(text) as portable, md5(text) as base, true as dictionary_if_frame from documents where text is not null")
def frames_of_bytes(spark, sf_dir):
    registry = trained(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("t"), P.pack_bytes(F.col("text").cast("binary"), "(6,documents)", registry).alias("b"))
    return docs.select(
        "doc_id", F.md5(P.read_frame(P.frame("b", False, registry), registry)).alias("stored"), F.md5(P.read_frame(P.frame("b", True, registry))).alias("portable"),
        F.md5(P.read_frame(P.frame_of("t", 3))).alias("base"), ((F.col("b.codec") == RAW) == P.dictionary_id_of("b").isNull()).alias("dictionary_if_frame"),
    )


@query("""select d.doc_id, d.text = f.text as same, d.text <> f.text as other, true as hashed, true as seeded from documents d, (select text from documents where text is not null order by doc_id limit 1) f
          where d.text is not null""")
def equality_of_bytes(spark, sf_dir):
    """Each document's bytes against the first one's, under other policies; hashes as of plain columns."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    first = docs.orderBy("doc_id").limit(1).select(P.pack_bytes(F.col("text").cast("binary"), "(9)").alias("f"))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("t"), P.pack_bytes(F.col("text").cast("binary"), "(1)").alias("b")).join(F.broadcast(first))
    return rows.select(
        "doc_id", P.packed_eq("b", "f", "bytes").alias("same"), P.packed_ne("b", "f", "bytes").alias("other"),
        (P.packed_hash("b", "bytes") == F.xxhash64("t")).alias("hashed"), (P.packed_hash("b", "bytes", seed=3) == F.xxhash64(F.lit(3).cast("long"), "t")).alias("seeded"),
    )


@query("select event_id, count(*) over (partition by event_type, user_id % 5) > 0 as hashes_meet, true as seeded_meet from events")
def hash_of_json(spark, sf_dir):
    """Documents that are equal but for the order of keys and the scale of numbers hash alike, seeded too."""
    user = F.col("user_id") % 5
    x = F.format_string('{"t": "%s", "u": %d}', "event_type", user)
    y = F.format_string('{"u": %d.0, "t": "%s"}', user, "event_type")
    rows = read_table(spark, sf_dir, "events").select("event_id", P.pack_json(x, "(1)").alias("x"), P.pack_json(y, "(9)").alias("y"))
    met = lambda **k: P.packed_hash("x", "json", **k) == P.packed_hash("y", "json", **k)
    return rows.select("event_id", met().alias("hashes_meet"), met(seed=7).alias("seeded_meet"))


@query("""select l_orderkey, l_linenumber, '{"k": ' || l_partkey || ', "note": "order line"}' as nest, '"' || l_linestatus || '"' as tag, null::varchar as none from lineitem""")
def json_by_path(spark, sf_dir):
    items = lines_of(spark, sf_dir)
    return items.select("l_orderkey", "l_linenumber", D.json_path("doc", ["nest"]).alias("nest"), D.json_path("doc", ["tags", "1"]).alias("tag"), D.json_path("doc", ["nest", "no"]).alias("none"))


@query("select c.conv_id::varchar as conv_id, c.turn::varchar as turn, b.item_id::varchar as item_id from conversations c full outer join benchmark b on c.text = b.text")
def outer_join(spark, sf_dir):
    left = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", P.pack_text("text", "(1)").alias("body"))
    right = read_table(spark, sf_dir, "benchmark").select("item_id", P.pack_text("text", "(9)").alias("other"))
    return R.join_packed(left, right, "body", "other", how="full_outer").select(*[F.col(c).cast("string").alias(c) for c in ("conv_id", "turn", "item_id")])


@query("select text from (select distinct text from documents where text is not null) order by text offset 5 limit 20")
def sort_and_offset(spark, sf_dir):
    rows = R.distinct_packed(docs_of(spark, sf_dir).where("body is not null").select("body"), {"body": "text"})
    return R.sort_unpacked(rows, "body").offset(5).limit(20).select(P.unpack("body").alias("text"))


@query("select r_name as region, n_regionkey::varchar as k, count(*) as n from nation join region on n_regionkey = r_regionkey group by cube (r_name, n_regionkey)")
def cube_by_value(spark, sf_dir):
    rows = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    packed = rows.select(P.pack_text("r_name").alias("region"), P.pack_text(F.col("n_regionkey").cast("string")).alias("k"))
    return R.grouping_sets_packed(packed, {"region": "text", "k": "text"}, F.count("*").alias("n"), cube=True).select("region", "k", "n")


@query("""select text, sum(turn)::bigint as turns, bool_and(turn < 3) as early, bool_or(turn = 0) as opens, string_agg(conv_id::varchar, ',' order by conv_id::varchar) as convs
          from conversations group by text""")
def other_aggregates(spark, sf_dir):
    """Sums, boolean and list aggregates of plain columns by packed value."""
    rows = read_table(spark, sf_dir, "conversations").select(P.pack_text("text").alias("body"), "turn", F.col("conv_id").cast("string").alias("c"))
    keyed = R.group_packed(
        rows, {"body": "text"}, F.sum("turn").alias("turns"), F.bool_and(F.col("turn") < 3).alias("early"), F.bool_or(F.col("turn") == 0).alias("opens"), F.array_join(F.array_sort(F.collect_list("c")), ",").alias("convs")
    )
    return keyed.select(P.unpack("body").alias("text"), "turns", "early", "opens", "convs")


@query("select doc_id, text from documents")
def dump_and_restore(spark, sf_dir):
    """A packed table dumped as plain Parquet and restored under another policy."""
    registry, dump = trained(spark, sf_dir), fresh(spark, "dump")
    table, restored = T.PackedTable(spark, fresh(spark, "table"), registry), T.PackedTable(spark, fresh(spark, "restored"), registry)
    table.write(read_table(spark, sf_dir, "documents").select("doc_id", "text"), {"text": ("text", "(6,documents)")}, uncompressed=True)
    T.export_logical(table.read(), dump, registry)
    T.import_logical(restored, dump, {"text": ("text", "(3)")})
    return restored.logical()


@query("select l_orderkey, l_linenumber, l_partkey::varchar as part from lineitem where l_returnflag = 'R'")
def extracted_columns(spark, sf_dir):
    """Plain columns beside the document take the place of an index on an expression."""
    path = fresh(spark, "extracted")
    D.with_extracted(lines_of(spark, sf_dir), "doc", {"flag": ["l_returnflag"], "part": ["nest", "k"]}).select("l_orderkey", "l_linenumber", "flag", "part").write.parquet(path)
    return spark.read.parquet(path).where("flag = 'R'").drop("flag")


@query("select conv_id, turn from conversations where text = (select min(text) from conversations)")
def hash_probe(spark, sf_dir):
    rows, path = read_table(spark, sf_dir, "conversations"), fresh(spark, "probe")
    T.probe_write(rows.select("conv_id", "turn", "text"), "text", path)
    return T.probe(spark, path, "text", rows.agg(F.min("text")).first()[0]).select("conv_id", "turn")


@query("select lang, lang as by_slot, true as whole, true as within_size from documents where text is not null group by lang having count(*) >= 8")
def registry_of_languages(spark, sf_dir):
    """Dictionaries trained and added for each language, found again by name, slot, id and bytes after a reload."""
    docs, registry = read_table(spark, sf_dir, "documents").where("text is not null"), Registry(spark, fresh(spark, "registry"))
    for r in docs.groupBy("lang").count().where("count >= 8").orderBy("lang").collect():
        registry.train_and_add(r["lang"], docs.where(F.col("lang") == r["lang"]).orderBy("doc_id").select("text"), 2048)
    again, rows = Registry(spark, registry.folder.path), []
    again.reload()
    for e in registry.entries():
        held = again.by_slot(again.slot(e.name))
        rows.append((e.name, held.name, again.bytes(e.dict_id) == e.data and dictionary_id(e.data) == e.dict_id, len(held.data) <= 2048))
    return spark.createDataFrame(rows, "lang string, by_slot string, whole boolean, within_size boolean")


@query()
def dictionary_evaluation(spark, sf_dir):
    return A.dictionary_report(read_table(spark, sf_dir, "documents"), "text", dict_bytes=8192)


@query()
def registry_inventory(spark, sf_dir):
    return trained(spark, sf_dir).inventory().drop("created_at")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["packed_header_report"](spark, sf_dir)

