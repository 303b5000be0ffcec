import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from test_operators import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.columns == docs.columns
        out = out.persist()
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name == "line_dedup":
            plain = brute_lines([(i, r.text or "") for i, r in before.items()])
            assert {i: r.text for i, r in after.items()} == {i: t for i, (t, _, _) in plain.items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "ngram_join":
            ids = sorted(before)
            _, labels = brute_components([before[i].text for i in ids], 5, 80)
            assert set(after) == {ids[i] for i in set(labels)}
        else:
            assert all(after[i] == before[i] for i in after) and len(after) > 0.5 * len(before)
        docs = out


def test_classifier_stages_keep_clean_and_drop_marked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in pipeline.toxicity(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    clean = [i for i, r in labels.items() if not r.toxic]
    assert sum(i in kept for i in clean) > 0.98 * len(clean)
    toxic = [i for i, r in labels.items() if r.toxic]
    assert sum(i not in kept for i in toxic) > 0.7 * len(toxic)
    kept = {r.doc_id for r in pipeline.quality(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    good = [i for i, r in labels.items() if r.quality]
    assert sum(i in kept for i in good) > 0.98 * len(good)


def test_odd_documents_pass_every_stage(spark, tmp_path):
    rows = [(None, "no id", "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four five six", "en", "s", 3), (3, "one two three four five six", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for df in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            df = stage(spark, df, str(tmp_path)).persist()
            df.count()


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_ngram_join", "op9_quality_rules"])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_sql_of_the_rules_on_odd_texts(spark):
    import random

    import duckdb
    import pyarrow as pa

    from rillflow.llm import cascade

    rng = random.Random(5)
    signs = ["abcdefgh", "ABCDEFGH", "0123456789", "!?", "#*$%&|<>", "éàüß漢字", "µª°·", ".,;:-_", "aeiou"]
    texts = [None, "", " \r\n\x0b", "\n\n\n", "word " * 60, "a\x00b c\u0301 " * 30]
    for _ in range(300):
        sets = rng.sample(signs, rng.choice([1, 2, 2, 3])) + rng.choice([[], ["abcdefgh"] * 3])
        words = ["".join(rng.choices(rng.choice(sets), k=rng.randint(1, rng.choice([3, 8, 20])))) for _ in range(rng.choice([40, 50, 60, 120]))]
        texts.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t", " \r\n"]) for w in words) + rng.choice(["", "\nsame line here" * 25]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = cascade.quality_cascade(docs).drop("rejected_by")
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({cascade.SQL})").fetchall()
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want)
    assert 20 < sum(r[-1] for r in rows) < sum(not r[-2] for r in rows) - 20


def test_all_queries_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_columns_that_clash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1)).withColumn("component_id", F.lit(2))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
