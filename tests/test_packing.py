import warnings

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stowage.codec import MAGIC
from stowage.functions import documents as D
from stowage.functions import packing as P
from stowage.operators import analyze as A
from stowage.operators import relational as R
from stowage.policy import Policy
from stowage.registry import Folder, Registry, RegistryError, train_dictionary
from stowage.sources import tables as T
from stowage.sync import main as sync_main
from stowage.sync import sync


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    r = Registry(spark, str(tmp_path_factory.mktemp("registry")))
    rows = spark.range(1000).select(F.concat(F.lit("sample subject "), F.col("id").cast("string"), F.repeat(F.md5(F.col("id").cast("string")), 4)).alias("t"))
    r.add("first", train_dictionary(rows, 2048), "a query")
    r.add("second", train_dictionary(rows.select(F.reverse("t").alias("t")), 2048))
    return r


def rows_of(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


TEXTS = ["", "héllo 😀", None, "a" * 63, "a" * 64, "sample subject 5 " * 50, "ä😀" * 1000]


@pytest.mark.parametrize("policy", ["(1)", "(6,first)", "(19,2)"])
def test_round_trip_with_nulls(spark, registry, policy):
    df = rows_of(spark, TEXTS).withColumn("c", P.pack_text("v", policy, registry))
    got = df.select("i", "v", P.unpack("c", "text", registry).alias("u"), F.col("c").isNull().alias("none")).collect()
    assert all(r["v"] == r["u"] and r["none"] == (r["v"] is None) for r in got) and len(got) == len(TEXTS)


def test_written_columns_are_read_leaf_by_leaf(spark, tmp_path):
    path = str(tmp_path / "t")
    rows_of(spark, TEXTS).select(P.pack_text("v").alias("c")).write.parquet(path)
    plan = spark.read.parquet(path).where("c.rawlen > 3").select("c.rawlen")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c:struct<rawlen:int>>" in plan and "GreaterThan(c.rawlen,3)" in plan and "Python" not in plan


def test_a_value_is_decoded_once(spark):
    df = rows_of(spark, TEXTS).withColumn("c", P.pack_text("v")).select(P.unpack("c").alias("u")).where("u > 'a'").select("u", F.length("u"))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2  # pack, unpack


def test_the_analyzer_refuses_order_and_comparison(spark):
    df = rows_of(spark, TEXTS).select("i", P.pack_text("v").alias("c"))
    for bad in (lambda: df.orderBy("c"), lambda: df.groupBy("c").count(), lambda: df.distinct(), lambda: df.agg(F.max("c")), lambda: df.where(F.col("c") == F.col("c")), lambda: df.dropDuplicates(["c"])):
        with pytest.raises(AnalysisException):
            bad().schema  # noqa: B018
    with pytest.raises(R.PackedRefusal):
        R.count_distinct("c")


def test_tolerant_packing(spark):
    df = rows_of(spark, ['{"a": 1}', "{broken", None, '{"b":1,"b":2}']).select("i", P.try_pack_json("v").alias("r"))
    got = {r["i"]: r for r in df.select("i", P.unpack(F.col("r.value"), "json").alias("v"), "r.problem").collect()}
    assert got[0]["v"] == '{"a": 1}' and got[3]["v"] == '{"b": 2}' and got[2]["v"] is None and got[2]["problem"] is None
    assert got[1]["v"] is None and "invalid input syntax" in got[1]["problem"]


def test_missing_dictionary_warns_once_and_stores_plainly(spark, registry):
    registry.new_write()
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        df = rows_of(spark, TEXTS).withColumn("c", P.pack_text("v", "(9,77)", registry)).withColumn("d", P.pack_text("v", "(9,77)", registry))
    assert sum("slot 77" in str(w.message) for w in said) == 1
    got = df.where("v is not null").select(F.col("c.level"), F.col("c.dict_id"), "v", P.unpack("c").alias("u")).collect()
    assert all(r["level"] == 9 and r["dict_id"] == 0 and r["u"] == r["v"] for r in got)
    with pytest.raises(RegistryError):
        P.recompress("c", 6, 77, registry)


def test_coerce_is_stricter_than_matches(spark, registry):
    df = rows_of(spark, ["x" * 10, "sample subject 5 " * 50]).withColumn("c", P.pack_text("v", "(6)"))
    raw = df.select(F.struct(*[(F.lit(0).cast("tinyint") if n == "codec" else F.col("v").cast("binary") if n == "payload" else F.col("c")[n]).alias(n) for n in P.LEAVES], F.lit(None).cast("variant").alias("guard")).alias("c"))
    assert [r[0] for r in raw.select(P.matches_policy("c", 6, 1, registry)).collect()] == [True, True]
    moved = raw.select(P.coerce("c", "(6,first)", registry).alias("c"))
    assert [r[0] for r in moved.select(F.col("c.codec")).collect()] == [0, 1]
    assert [r[0] for r in raw.select(P.coerce("c", None).alias("c")).select("c.codec").collect()] == [0, 0]


def test_relabelled_kind_is_refused_by_readers_and_kept_by_rewriters(spark):
    df = rows_of(spark, ["sample subject " * 20]).select(P.pack_text("v").alias("c"))
    c = F.struct(*[(F.lit(3).cast("tinyint") if n == "kind" else F.col("c")[n]).alias(n) for n in P.LEAVES], F.lit(None).cast("variant").alias("guard"))
    bad = df.select(c.alias("c"))
    assert bad.select(P.validate("c", "text")).first()[0] == "invalid value header" == bad.select(P.header_problem("c", "text")).first()[0]
    assert bad.select(P.recompress("c", 9).alias("c")).select("c.kind").first()[0] == 3
    assert bad.select(F.col("c.magic")).first()[0] == MAGIC


def test_json_readers_on_columns(spark):
    df = rows_of(spark, ['{"a": [1, null], "k": "a", "n": null}', None, "[1, 2]"]).withColumn("c", P.pack_json("v"))
    got = df.select("i", D.json_field("c", F.lit("n")).alias("n"), D.json_field_text("c", "n").alias("t"), D.json_element("c", -1).alias("e"), D.json_has_any("c", ["k", "z"]).alias("h"), D.json_field("c", F.lit(None).cast("string")).alias("none")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [("null", None, None, True, None), (None, None, None, None, None), (None, None, "2", False, None)]


def test_arrays_of_packed_values(spark):
    df = spark.createDataFrame([(["a", "b" * 100, None],)], "v array<string>").select(F.explode("v").alias("v")).select("v", P.pack_text("v").alias("c"))
    nested = df.agg(F.array_agg("c").alias("cs"))
    assert nested.select(F.transform("cs", lambda c: c["rawlen"]).alias("n")).first()["n"] == [1, 100]


def test_registry_rules(spark, tmp_path, registry):
    r = Registry(spark, str(tmp_path / "other"))
    a, b = registry.entries()
    assert r.import_(2, "x", a.data) == 2 and r.import_(5, "y", b.data) == 5 and r.import_(2, "x", a.data) == 2
    for slot, name, data, code in ((2, "z", b.data, "duplicate"), (3, "x", b.data, "duplicate"), (3, "z", a.data, "duplicate"), (0, "z", a.data, "invalid"), (3, "12", a.data, "invalid"), (3, "", a.data, "invalid"), (3, None, a.data, "null"), (None, "z", a.data, "null"), (3, "z", b"short", "invalid")):
        with pytest.raises(RegistryError) as error:
            r.import_(slot, name, data)
        assert error.value.code == code
    rows = spark.range(50).select(F.md5(F.col("id").cast("string")).alias("t")).select(F.repeat("t", 9).alias("t"))
    assert r.add("third", train_dictionary(rows, 1024)) == 6  # after the highest, gaps stay
    assert r.slot("third") == 6 and r.bytes(a.dict_id) == a.data and r.bytes(1) is None
    with pytest.raises(RegistryError):
        r.slot("none")
    assert [x["slot"] for x in r.inventory().orderBy("slot").collect()] == [2, 5, 6]


def test_training_bounds(spark):
    rows = spark.range(5).select(F.lit("x" * 50).alias("t"))
    for df, size, sample in ((rows, 2048, 8192), (rows, 10, 10), (rows, 2048, 0), (spark.range(5), 2048, 10), (rows.select("t", "t"), 2048, 10)):
        with pytest.raises(RegistryError):
            train_dictionary(df, size, sample)


def test_sync_codes(spark, tmp_path, registry):
    """0 in sync, 1 a collision that writes nothing, 2 differences remain, 3 a failure."""
    target, said = Registry(spark, str(tmp_path / "t")), []
    assert sync(registry, target, check=True, say=said.append) == 2 and said[0].startswith("missing slot 1")
    assert sync(registry, target, dry_run=True, say=said.append) == 0 and said[-1] == "in sync (dry run)" and not target.entries()
    assert sync(registry, target, say=said.append) == 0 and said[-1] == "in sync" and sync(registry, target, check=True, say=said.append) == 0
    other = Registry(spark, str(tmp_path / "u"))
    other.add("local", registry.entries()[1].data)
    assert sync(registry, other, say=said.append) == 1 and "nothing is written" in said[-1] and len(other.entries()) == 1
    assert sync_main([str(tmp_path / "t"), str(tmp_path / "u"), "--table", "x", str(tmp_path / "no"), "nofs://there"]) == 3


def test_sync_compares_policies(spark, tmp_path, registry):
    target = Registry(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(i, f"sample subject {i} " * 9) for i in range(9)], "i int, body string")
    here, there = T.PackedTable(spark, str(tmp_path / "here"), target), T.PackedTable(spark, str(tmp_path / "there"), registry)
    there.write(rows, {"body": ("text", Policy(6, 1))})
    here.write(rows.limit(0), {"body": ("text", Policy(6, 1))})
    said: list[str] = []
    assert sync(registry, target, check=True, say=said.append, tables={"m": (there, here)}) == 2 and said[-1] == "m.body: slot not registered here"
    assert sync(registry, target, dry_run=True, say=said.append, tables={"m": (there, here)}) == 0 and not target.entries()
    assert sync(registry, target, say=said.append, tables={"m": (there, here)}) == 0
    here.set_policy("body", 9, 1)
    assert sync(registry, target, say=said.append, tables={"m": (there, here)}) == 2 and said[-1] == "m.body: different level"


def test_files_are_published_whole(spark, tmp_path, registry):
    folder = Folder(spark, str(tmp_path / "f"))
    assert folder.write("slot-1", b"one") and not folder.write("slot-1", b"two") and folder.read("slot-1") == b"one"
    assert folder.write("slot-1", b"three", replace=True) and folder.read("slot-1") == b"three"
    half = Registry(spark, str(tmp_path / "r"))
    half.import_(1, "first", registry.entries()[0].data)
    (tmp_path / "r" / ".slot-00000002.json.abc").write_bytes(b'{"slot": 2, "na')  # a writer that died
    half.reload()
    assert [e.slot for e in half.entries()] == [1] and half.import_(2, "second", registry.entries()[1].data) == 2
    assert [n for n in folder.names() if not n.startswith(".")] == ["slot-1"]


def test_a_batch_that_runs_again_is_stored_once(spark, tmp_path, registry):
    table = T.PackedTable(spark, str(tmp_path / "table"), registry)
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "i int, body string")
    table.write(rows.limit(2), {"body": ("text", "(6)")})
    for _ in range(2):
        table.write(rows, part="stream-0")
    table.write(rows.limit(1), part="stream-1")
    assert table.read().count() == 12 and table.logical().where("body = 'text 8'").count() == 1


def test_table_policies(spark, tmp_path, registry):
    table = T.PackedTable(spark, str(tmp_path / "table"), registry)
    df = spark.createDataFrame([(i, f"sample subject {i} " * 20 if i > 1 else "tiny", None if i % 2 else '{"b":1,"a":2}') for i in range(23)], "i int, body string, meta string")
    table.write(df, {"body": ("text", "(6)"), "meta": ("json", None)})
    assert table.read().schema["body"].metadata["packed"]["level"] == 6
    table.set_policy("body", 6, "first")
    with pytest.raises(ValueError, match="21 values"):  # two are raw and match any dictionary
        table.finish_policy("body")
    assert table.catch_up("body") == 21 and table.catch_up("body") == 0
    assert table.finish_policy("body") and not table.finish_policy("body")
    table.write(df.where("i < 3"))
    assert table.logical().count() == 26 and table.behind("body").count() == 0
    assert {r["meta"] for r in table.logical().collect()} == {None, '{"a": 2, "b": 1}'}
    assert table.repack("body", "(3)") and not table.repack("body", "(3)")
    assert {r[0] for r in table.read().select("body.level").collect()} == {3}


def test_catch_up_rewrites_only_files_that_are_behind(spark, tmp_path, registry):
    table = T.PackedTable(spark, str(tmp_path / "table"), registry)
    rows = lambda a, b: spark.createDataFrame([(i, f"sample subject {i} " * 20) for i in range(a, b)], "i int, body string")
    table.write(rows(0, 40).repartition(8), {"body": ("text", "(6)")})
    before = set(table._files())
    table.set_policy("body", 9)
    table.write(rows(40, 50).coalesce(1))  # on the new policy already
    fresh = set(table._files()) - before
    done = [table.catch_up("body", 3, n) for n in range(3)]
    assert sum(done) == 40 and sum(map(bool, done)) > 1  # a slice at a time
    assert fresh <= set(table._files()) and not before & set(table._files())
    assert table.catch_up("body") == 0 and table.finish_policy("body")
    assert sorted(r["i"] for r in table.logical().collect()) == list(range(50))
    assert table.vacuum() == len(before) and table.vacuum() == 0 and table.read().count() == 50


def test_rewrites_keep_what_others_append_and_refuse_what_others_replaced(spark, tmp_path, registry, monkeypatch):
    table = T.PackedTable(spark, str(tmp_path / "table"), registry)
    rows = lambda a, b: spark.createDataFrame([(i, f"sample subject {i} " * 20) for i in range(a, b)], "i int, body string")
    table.write(rows(0, 5), {"body": ("text", "(6)")})
    table.write(rows(5, 9), part="one")

    def change(meanwhile):
        def run(df):
            meanwhile()
            return [df[c] for c in df.columns]

        return run

    table._replace(table._files(), change(lambda: table.write(rows(9, 12))))
    assert sorted(r["i"] for r in table.logical().collect()) == list(range(12))
    table.write(rows(5, 8), part="one")  # after its rows moved: replaced whole all the same
    assert sorted(r["i"] for r in table.logical().collect()) == [*range(8), *range(9, 12)]
    files, look = table._files(), table._files

    def late():  # the new files are written, but not yet published
        monkeypatch.setattr(table, "_files", look)
        table.write(rows(5, 7), part="one")
        return look()

    monkeypatch.setattr(table, "_files", late)
    with pytest.raises(ValueError, match="meanwhile"):
        table._replace(files, lambda df: [df[c] for c in df.columns])
    assert sorted(r["i"] for r in table.logical().collect()) == [*range(7), *range(9, 12)]
    with pytest.raises(ValueError, match="named"):
        table.write(rows(0, 1), part="a/b")


def test_ingest_of_files_skips_bad_rows(spark, tmp_path, registry):
    (tmp_path / "rows.csv").write_text('1;{"b": 1, "a": 2};x\n2;{broken;x\n3;;y\nno;{};z\n5;[1];w\n')
    table = T.PackedTable(spark, str(tmp_path / "table"), registry)
    policies = {"meta": ("json", "(9,first)"), "body": ("text", "(3)")}
    with pytest.raises(Exception, match="(?i)json|malformed"):
        table.ingest(str(tmp_path / "rows.csv"), "id int, meta string, body string", policies=policies, sep=";")
    table = T.PackedTable(spark, str(tmp_path / "other"), registry)
    assert table.ingest(str(tmp_path / "rows.csv"), "id int, meta string, body string", on_error="ignore", policies=policies, sep=";") == 2
    assert [tuple(r) for r in table.logical().orderBy("id").collect()] == [(1, '{"a": 2, "b": 1}', "x"), (3, None, "y"), (5, "[1]", "w")]
    (tmp_path / "rows.json").write_text('{"id": 6, "meta": "{}", "body": "v"}\n{"id": 7, "meta\n{"id": 8, "meta": "1 2"}\n')
    assert table.ingest(str(tmp_path / "rows.json"), "id int, meta string, body string", "json", "ignore") == 2
    assert table.read().count() == 4 and table.behind("meta").count() == table.behind("body").count() == 0
    for given in ({"on_error": "maybe"}, {"form": "orc"}):
        with pytest.raises(ValueError):
            table.ingest("x", "id int", **given)


def test_dictionary_report_of_the_tail(spark):
    df = spark.range(1200).selectExpr("id", "if(id % 100 = 7, null, concat('sample subject ', id, ' of the tail, stored with a dictionary of its own ', md5(cast(id as string)))) as v")
    rows = A.dictionary_report(df, "v", levels=(1, 3), dict_bytes=2048, tail="id").collect()
    assert {r["level"] for r in rows} == {1, 3} and all(r["n_values"] == 297 for r in rows)  # the last 300, three of them null
    assert all(0 < r["dictionary_bytes"] < r["plain_bytes"] and r["payback_values"] > 0 and min(r[c] for c in A.COSTS) > 0 for r in rows)


def test_most_common_values_under_a_policy(spark, registry):
    texts = [f"sample subject {i % 3} " * 9 for i in range(10)] + ["once", None]
    df = rows_of(spark, texts).select(P.pack_text("v", "(1)").alias("c"))
    top = A.most_common_values(df, "c", registry=registry, policy="(9,first)")
    rows = top.select(P.unpack("value", "text", registry).alias("v"), "n", "value.level", P.dictionary_id_of("value").alias("d")).collect()
    first = next(e.dict_id for e in registry.entries() if e.name == "first")
    assert [tuple(r) for r in rows] == [(texts[0], 4, 9, first), (texts[1], 3, 9, first), (texts[2], 3, 9, first)]
    doc = rows_of(spark, ['{"a": 1.0, "b": "x"}', '{"b":"x","a":1}', "null"]).select(P.pack_json("v").alias("c"))
    assert [tuple(r) for r in A.most_common_values(doc, "c", "json", policy="(3)").select(P.unpack("value", "json"), "n").collect()] == [('{"a": 1, "b": "x"}', 2)]


def test_columns_share_one_snapshot(spark, registry):
    held = P._dictionaries(registry)
    assert P._dictionaries(registry) is held and P._dictionaries(held) is held and P._dictionaries(registry, {registry.entries()[0].dict_id}) is not held
    registry.reload()
    assert P._dictionaries(registry) is held and P._dictionaries(None).sent is None


def test_partition_pruning_plan(spark, tmp_path):
    path = str(tmp_path / "p")
    T.partitioned_write(spark.createDataFrame([(str(i % 7),) for i in range(100)], "k string"), "k", path, 4)
    df = T.partitioned_read(spark, path, "k", "3", 4)
    assert df.count() == len([i for i in range(100) if i % 7 == 3])
    assert "PartitionFilters: [isnotnull(part" in df._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    df = rows_of(spark, []).withColumn("c", P.pack_text("v"))
    assert df.select(P.unpack("c")).count() == 0 and R.group_packed(df, {"c": "text"}, F.count("*").alias("n")).count() == 0
    assert R.count_distinct_packed(df, "c").first()["n"] == 0


def test_cache_statistics(spark, registry):
    stats = P.CacheStats(spark)
    held = P.Dictionaries(registry, stats=stats)
    df = rows_of(spark, [f"sample subject {i} " * 20 for i in range(10)]).select(P.pack_text("v", "(6,first)", registry).alias("c")).cache()
    assert df.count() == 10
    df.select(P.unpack("c", "text", held)).write.format("noop").mode("overwrite").save()
    got = stats.values()
    assert got["misses"] == 10 and got["hits"] == 0 and 1 <= got["loads"] <= 10
    df.select(P.validate("c", "text", held)).write.format("noop").mode("overwrite").save()
    assert stats.values()["misses"] == 10  # validation leaves the cache alone


def test_extracted_columns_and_probes(spark, tmp_path):
    df = rows_of(spark, ['{"k": "a", "n": 1}', '{"k": "b"}', None]).select("i", P.pack_json("v").alias("doc"))
    got = {r["i"]: (r["k"], r["n"]) for r in D.with_extracted(df, "doc", {"k": ["k"], "n": ["n"]}).collect()}
    assert got == {0: ("a", "1"), 1: ("b", None), 2: (None, None)}
    T.probe_write(rows_of(spark, ["x", "y", "x"]), "v", str(tmp_path / "p"))
    assert sorted(r["i"] for r in T.probe(spark, str(tmp_path / "p"), "v", "x").collect()) == [0, 2]


def test_dump_and_restore(spark, tmp_path, registry):
    a, b = T.PackedTable(spark, str(tmp_path / "a"), registry), T.PackedTable(spark, str(tmp_path / "b"))
    a.write(rows_of(spark, TEXTS), {"v": ("text", "(6,first)")})
    T.export_logical(a.read(), str(tmp_path / "dump"), registry)
    T.import_logical(b, str(tmp_path / "dump"), {"v": ("text", "(3)")})
    assert sorted(map(repr, b.logical().collect())) == sorted(map(repr, a.logical().collect()))
    assert {r[0] for r in b.read().where("v is not null").select("v.dict_id").collect()} == {0}
