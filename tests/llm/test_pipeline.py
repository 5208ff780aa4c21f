import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyfold.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def test_registry():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
    assert set(queries.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    got = queries.queries()[name](spark, SF).toArrow()
    expected = duck.sql(queries.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(expected.column_names)
    rows = lambda t: sorted(str(tuple(r[c] for c in columns)) for r in t.to_pylist())
    assert rows(got) == rows(expected)
    assert [str(got.schema.field(c).type) for c in columns] == [str(expected.schema.field(c).type) for c in columns]


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = " ".join(say(40))
    rows, labels, fate = [], [], {}
    for i in range(400):
        words = say(150)
        kind = "toxic" if i % 5 == 0 else "clean"
        if kind == "toxic":
            for w in ("moron", "stupid", "trash", "moron"):
                words.insert(rng.randrange(len(words)), w)
        labels.append((i, 1, int(kind == "toxic")))
        fate[i] = kind
        rows.append((i, " ".join(words) + ("\nshared footer" if i % 3 == 0 else ""), "en", f"s{i % 4}", 0))
    base = say(300)
    near = base[:]
    near[150] = "changed"
    rows += [(1000, " ".join(base), "en", "s1", 0), (1001, " ".join(base), "en", "s2", 0), (1002, " ".join(near), "en", "s3", 0)]
    rows += [(1003, " ".join(say(60)) + " " + passage.upper() + " " + " ".join(say(60)), "en", "s0", 0), (1004, None, None, None, None), (1005, "", "en", "s1", 0), (1006, passage + " " + " ".join(say(2000)), "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, " ".join(say(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = {i for i, f in fate.items() if f == "clean"}
    assert clean <= kept[0] and len(kept[0] & {i for i, f in fate.items() if f == "toxic"}) <= 4
    assert kept[1] == kept[0]
    assert spark.read.parquet(str(tmp_path / "out1")).filter(F.col("text").contains("shared footer")).isEmpty()
    assert kept[1] - kept[2] == {1001, 1002, 1005}  # 1005 is empty as 1004 is
    assert kept[2] - kept[3] == {1003} and kept[4] == kept[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))
