"""Every stage of the pipeline, on odd rows too."""

import random

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
random.seed(9)


def prose(n):
    return " ".join(f"w{random.randrange(500)}" for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    item = prose(40)
    base = prose(60)
    rows = [(i, f"{prose(30)} {'vile' if i % 4 == 0 else 'kind'} {prose(5)}", "en", "ab"[i % 2], 7) for i in range(400)]
    rows += [(1000, base, "en", "a", 0), (1001, base, "en", "b", 0), (1002, base + " more", "en", None, 0)]
    rows += [(1003, f"{prose(20)} {item} {prose(9)}", "en", "a", 0), (1004, f"write to ann@corp.com or Zorblatt {prose(9)}", None, "a", 0)]
    # a null and a repeated doc_id: each row is judged by itself
    rows += [(None, f"{prose(30)} vile {prose(5)}", "en", "a", 0), (None, f"{prose(9)} {item}", "en", "a", 0), (None, prose(30) + " kind", "en", "a", 0)]
    rows += [(1005, f"{prose(30)} vile {prose(5)}", "en", "a", 0), (1005, prose(30) + " kind", "en", "a", 0), (1006, "same words here twice over", "en", "a", 1), (1006, "same words here twice over", "en", "a", 2)]
    rows += [(1007, None, None, None, None), (1008, "", "de", "b", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())


def test_each_stage_decides_by_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    before = ids(docs)
    for name, stage in cp.STAGES[:4]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes), name
        if name == "toxicity":
            assert ids(got) == [x for x in before if "vile" not in (x[1] or "")]
        if name == "near_dedup":
            assert sorted(i for i, _ in ids(got)) == sorted([i for i, _ in before if i not in (1001, 1002, 1006, 1008)] + [1006])
            assert got.filter("doc_id = 1006").first().n_chars == 1
        if name == "decontamination":
            leaking = [x for x in before if (x[0] == 1003 or x[0] == -1) and "vile" not in (x[1] or "") and "kind" not in (x[1] or "")]
            assert ids(got) == [x for x in before if x not in leaking] and len(leaking) == 2
        if name == "personal_data":
            said = {r.doc_id: r for r in got.collect()}
            assert got.count() == len(before) and said[1004].text.startswith(" to [EMAIL] or") and said[1004].n_chars == len(said[1004].text) and said[1007].text is None and said[1007].n_chars is None and said[3].text == dict(before)[3]


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    got = cp.run(spark, sf_dir).toPandas()
    assert len(got) == sum(1 for i in range(400) if i % 4) + 1 + 1 + 1 + 1 + 1 + 1
    assert (got.taken <= 3 * got["size"]).all()
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
