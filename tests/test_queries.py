"""Each registered query of the library against its SQL."""

import duckdb
import pytest

from pyspark.sql import functions as F

from stowage.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def normal(df, columns):
    df = df[columns].astype(object)
    return df.where(df.notna(), None).astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert normal(got, columns).equals(normal(want, columns))


def test_all_sizes_are_validated_and_matched(spark, tmp_path):
    """Values of 64 to 399 bytes on both sides of the choice between raw and zstd, beside shorter and longer ones."""
    import random

    import zstandard

    from stowage.plans.queries import _matches, _sweep, docs_of, trained

    draw = random.Random(7)
    words = "river cloud paper light north south early late small large open close".split()
    texts = [" ".join(draw.choices(words, k=draw.randint(80, 200))) for _ in range(150)] + [None, "", "a" * 63]
    for n in (64, 65, 80, 120, 200, 300, 398, 399, 400, 700):
        texts += ["".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(n // 3)) + "x" * (n % 3), "z" * n, "".join(draw.choices([chr(c) for c in range(1, 128)], k=n))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    registry = trained(spark, str(tmp_path))
    held = zstandard.ZstdCompressionDict(registry.bytes(registry.resolve(1)), dict_type=zstandard.DICT_TYPE_FULLDICT)
    plain, by_dictionary = (zstandard.ZstdCompressor(level=6, dict_data=d, write_checksum=True, write_content_size=True) for d in (None, held))
    raw = lambda writer, t: len(t.encode()) < 64 or len(writer.compress(t.encode())) >= len(t.encode())
    sizes = [None if t is None else len(t.encode()) for t in texts]
    for writer in (plain, by_dictionary):
        assert {raw(writer, t) for t, n in zip(texts, sizes, strict=True) if n and 64 <= n < 400} == {True, False}
    got = {r["doc_id"]: r for r in _sweep(docs_of(spark, str(tmp_path), "(6)")).collect()}
    found = {r["doc_id"]: r for r in _matches(docs_of(spark, str(tmp_path), "(6,documents)", registry), registry).collect()}
    assert set(got) == set(found) == set(range(len(texts)))
    for i, t in enumerate(texts):
        if t is None:
            assert list(got[i])[1:] == [None] * (len(got[i]) - 1) and found[i]["at_six"] is None
            continue
        length = "invalid raw value length" if raw(plain, t) else "invalid frame header"
        want = {"doc_id": i, "clean": None, "magic": "invalid or unsupported storage format", "kind": "invalid value header", "level": "invalid value header", "length": length}
        assert got[i].asDict() == want
        assert found[i].asDict() == {"doc_id": i, "at_six": True, "at_nine": False, "no_dictionary": raw(by_dictionary, t)}


def test_corrupt_lengths_and_misplaced_dictionaries_show(spark, tmp_path):
    """The columns that SQL states as constants are not constant where something is wrong."""
    from stowage.plans import queries

    texts = ["a", "b" * 70, "words of a longer text " * 30] * 20
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert all(r["stored_rightly"] and r["at_six"] for r in queries.matches_policy_headers(spark, str(tmp_path)).collect())
    assert all(r["length_found"] for r in queries.validate_sweep(spark, str(tmp_path)).collect())
    bare = queries._sweep(queries.docs_of(spark, str(tmp_path), "(6)").withColumn("bytes", F.lit(1)), "bytes").where("length is null").count()
    assert bare == 0


def test_entry_runs_without_the_corpus_part(spark, monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def missing(name, *a, **k):
        if name == "corpus_pipeline" or name.startswith("stowage.llm"):
            raise ModuleNotFoundError(name, name="corpus_pipeline" if name == "corpus_pipeline" else "stowage.llm")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", missing)
    sys.modules.pop("__spark_entry__", None)
    module = importlib.import_module("__spark_entry__")
    assert set(module.queries()) == set(QUERIES) and set(module.oracle_sql()) == set(SQL)
    assert module.entry(spark).count() > 0
    sys.modules.pop("__spark_entry__", None)
