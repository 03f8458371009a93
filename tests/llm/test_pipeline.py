"""The pipeline's stages, each against what its operator says of its input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm import langid, mixing, ngram_join, packing
from tessera.llm.shared import read, written
from tests.llm.test_llm_spark import KINDS, check_packing, odd_rows
from tests.llm.test_llm_units import brute_set


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = read(spark, data, "documents"), []
    for name, stage in pipeline.STAGES:
        got = written(stage(spark, docs, data), name)
        out.append((docs, got))
        docs = got
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "mixing", "packing"]
    for docs, got in stages[:-1]:
        assert got.columns == docs.columns and got.dtypes == docs.dtypes


def test_language_keeps_documents_that_have_one(stages):
    docs, got = stages[0]
    kept = set(ids(got))
    rejected = {r["doc_id"] for r in langid.identify(docs, docs).where("language.rejected").collect()}
    assert kept == set(ids(docs)) - rejected and len(rejected) < 0.02 * docs.count()


def test_toxic_documents_go_and_others_stay(spark, data):
    larger = data.replace("sf0.001", "sf0.01")  # the smallest tables have too few toxic labels to learn from
    docs = read(spark, larger, "documents")
    kept = set(ids(pipeline.without_toxic(spark, docs, larger)))
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, larger, "labels").collect()}
    clean = [i for i in ids(docs) if labels.get(i) == 0]
    toxic = [i for i in ids(docs) if labels.get(i) == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i in kept for i in toxic) <= 0.5 * len(toxic)


def test_one_of_each_group_stays(stages):
    docs, got = stages[2]
    found = ngram_join.near_duplicates(docs).collect()
    assert ids(got) == sorted({r["component_id"] for r in found})


def test_rows_are_told_apart_by_id_and_text(spark, data):
    """Against brute force: components by the similarity of all pairs; the smallest id of each stays."""
    t, u = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, t), (2, t), (2, "another text of the same id"), (3, "text a of three"), (3, "text b of three"), (3, "text b of three"), (None, t), (None, u + " end"), (4, u), (5, None), (5, None), (6, " ")]
    docs = spark.createDataFrame([(i, x, k % 2) for k, (i, x) in enumerate(rows)], "doc_id long, text string, k int")
    sets = [brute_set(x) for _, x in rows]
    near = [[bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b) for b in sets] for a in sets]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if near[i][j] or i == j) for i in range(len(rows))]
    want = []
    for g in set(group):
        mine = [rows[i] for i in range(len(rows)) if group[i] == g]
        want.append(min(mine, key=lambda r: (r[0] is None, r[0] or 0)))
    got = [(r["doc_id"], r["text"], r["k"]) for r in pipeline.one_of_each(spark, docs, data).collect()]
    assert sorted(map(str, [g[:2] for g in got])) == sorted(map(str, want))
    assert (3, "text b of three", 0) in got  # of equal rows the least by the other columns
    again = docs.repartition(7, "k")
    assert sorted(map(str, got)) == sorted(map(str, [tuple(r) for r in pipeline.one_of_each(spark, again, data).collect()]))


def test_mix_repeats_documents(stages):
    docs, got = stages[3]
    want = []
    for r in mixing.mix(docs).collect():
        want += [r["doc_id"]] * -(-r["taken"] // r["size"] if r["taken"] else 0)
    assert ids(got) == sorted(want)


def test_packing_holds_every_document(stages):
    docs, got = stages[4]
    table = got.toPandas()
    check_packing(table, packing.CAPACITY)
    assert sorted(table[table["piece"] == 0]["doc_id"]) == ids(docs)


def test_run_equals_the_stages(spark, data, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = pipeline.run(spark, data).select(*key)
    assert got.exceptAll(stages[4][1].select(*key)).count() == 0 and got.count() == stages[4][1].count()


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_stages_take_odd_rows(spark, data, rows):
    docs = spark.createDataFrame(rows, KINDS)
    plain = {(r[0], r[1]) for r in rows}
    letters = {x for x in plain if any(c.isalpha() for c in x[1] or "")}
    words = {x for x in plain if (x[1] or "").split()}
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, data)
        if name == "packing":
            assert got.where("piece = 0").count() == len(rows)
            continue
        assert got.columns == docs.columns
        kept = [(r["doc_id"], r["text"]) for r in got.collect()]
        if name == "language_id":
            assert set(kept) == letters and len(kept) == sum((r[0], r[1]) in letters for r in rows)
        elif name == "toxicity":
            assert sorted(map(str, kept)) == sorted(str((r[0], r[1])) for r in rows)
        elif name == "near_duplicates":
            ids = [i for i, _ in kept if i is not None]
            assert len(ids) == len(set(ids)) and (set(ids), len(kept) - len(ids)) == (({1, 2, 3, 4, 9, 10, 11, 12}, 2) if rows else (set(), 0))
        else:
            assert set(kept) <= words and (bool(kept) == bool(rows))


def test_columns_of_any_name_stay_as_they_are(spark, data):
    docs = spark.createDataFrame(odd_rows(), KINDS)
    names = ["_language", "_score", "_turn", "_times", "_copy", "_group", "_content", "language", "taken", "bucket"]
    for k, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(k))
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, data)
        assert got.columns == docs.columns, name
        assert {tuple(r) for r in got.select(*names).distinct().collect()} == {tuple(range(len(names)))}, name


@pytest.mark.parametrize("labels", [[], [(i, 1) for i in range(40)], [(i, i % 2) for i in range(40)]])
def test_without_anything_to_learn_no_text_goes(spark, tmp_path, labels):
    rows = [(i, None if i == 7 else "..." if i == 8 else "same words for all", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert ids(pipeline.without_toxic(spark, docs, str(tmp_path))) == list(range(40))
    assert ids(pipeline.language_id(spark, docs, str(tmp_path))) == [i for i in range(40) if i not in (7, 8)]
