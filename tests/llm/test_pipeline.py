import random

import corpus_pipeline
from stowage.llm import neardup, toxicity
from tests.llm.data import documents, prose, rows_of
from tests.llm.test_operators import brute_components, toxic_corpus


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    docs = documents(spark, seed=8, n=40)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    best = {}
    for i, t in rows:  # equal texts: the largest id, null below all
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        if key not in best or (i is not None and (best[key][0] is None or i > best[key][0])):
            best[key] = (i, t)
    left = list(best.values())
    kept = [x for x, (i, _, root) in zip(left, brute_components(left, 5, 80), strict=True) if i is None or i == root]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, (r["doc_id"] for r in got.collect() if r["piece"] == 0))) == sorted(repr(i) for i, _ in kept)


def test_stages_keep_columns_and_bear_empty_tables(spark, tmp_path):
    docs = documents(spark, n=12)
    for name in ("documents", "labels"):
        (docs if name == "documents" else spark.createDataFrame([], "doc_id long, quality int, toxic int")).write.parquet(str(tmp_path / f"{name}.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert rows_of(stage(spark, docs.limit(0), str(tmp_path))) == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_toxicity_is_decided_row_by_row(spark, tmp_path):
    docs, labels = toxic_corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad, good = (next(texts[i] for i in range(400) if i % 4 == 0 and scores[i] == 1), next(texts[i] for i in range(1, 400) if i % 4 and scores[i] == 0))
    more = spark.createDataFrame([(None, bad), (None, good), (5001, bad), (5001, good), (5002, None)], "doc_id long, text string")
    want = [(i, t) for i, t in ((r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()) if not scores[i]]
    want += [(None, good), (5001, good), (5002, None)]
    got = corpus_pipeline.keep_civil(spark, docs.where("doc_id is not null").union(more), str(tmp_path))
    assert rows_of(got) == sorted(map(repr, want))


def test_near_copies_are_judged_row_by_row(spark):
    draw = random.Random(3)
    a, b, c, d = (prose(draw, 100) for _ in range(4))
    near = lambda t, w: f"{t} {w}"
    rows = [(None, a), (None, near(a, "x")), (None, near(a, "y")), (7, b), (7, c), (6, near(b, "x")), (8, near(c, "x")), (None, near(c, "y")), (9, d), (9, near(d, "x")), (None, None), (None, ""), (9, " "), (None, None)]
    got = [tuple(r) for r in neardup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    for t, ids in ((a, [None]), (b, [6]), (c, [7]), (d, [9])):
        assert [i for i, x in got if x and x.startswith(t)] == ids
    assert sorted(map(repr, (r for r in got if not (r[1] or "").strip()))) == sorted(map(repr, rows[-4:]))
    assert len(got) == 8
