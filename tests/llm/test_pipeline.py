import random

from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import pieces


def corpus(path, spark):
    r = random.Random(2)
    words = ["the", "tall", "house", "stands", "near", "that", "old", "river", "and", "we", "see", "it"] + ["".join(r.choice("aeionrst") for _ in range(5)) for _ in range(200)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, make(120)) for i in range(60)]
    items = [(1, make(30)), (2, make(25))]
    rows += [(100, rows[3][1]), (101, rows[4][1]), (102, "short"), (103, make(60) + " " + items[0][1] + " " + make(60)), (104, "a b c " * 60)]
    passage = make(120)
    rows += [(200, make(80) + "\n" + passage + "\n" + make(80)), (201, make(80) + "\n" + passage + "\n" + make(80)), (202, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return passage


def test_each_stage_takes_effect(spark, tmp_path):
    passage = corpus(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = [f for _, f in corpus_pipeline.STAGES]
    good = steps[0](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    assert {x.doc_id for x in good.collect()} == {x.doc_id for x in docs.collect()} - {102, 104, 202}
    single = steps[1](spark, good, str(tmp_path))
    assert {x.doc_id for x in good.collect()} - {x.doc_id for x in single.collect()} == {100, 101}
    cut = steps[2](spark, single, str(tmp_path))
    texts = {x.doc_id: x for x in cut.collect()}
    assert cut.columns == docs.columns and all(passage[20:-20] not in texts[d].text and len(texts[d].text) == texts[d].n_chars for d in (200, 201))
    clean = steps[3](spark, cut, str(tmp_path))
    assert set(texts) - {x.doc_id for x in clean.collect()} == {103}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lattice = pieces.Lattice(pieces.load(pieces.model_path()))
    assert {x.doc_id: lattice.decode(x.ids) for x in out} == {d: x.text for d, x in texts.items() if d != 103}


def test_stages_on_empty_tables_nulls_ties_and_clashing_names(spark, tmp_path):
    passage = corpus(str(tmp_path), spark)
    assert passage
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    clash = docs.withColumn("row", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("text_hash", F.lit(None).cast("string"))
    nulls = clash.unionByName(clash.where("doc_id = 7")).unionByName(clash.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in clash.schema)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, nulls, str(tmp_path))
        assert out.columns == nulls.columns, name
        left = out.where("doc_id = 7").count()  # rows of one id stay together; what stands twice is cut whole
        assert left == {"suffix-array dedup": 0}.get(name, 2), name
    assert corpus_pipeline.STAGES[-1][1](spark, nulls, str(tmp_path)).where("doc_id = 7").count() == 2


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shortest_passages_of_over_fifty_words_are_cut(spark, tmp_path):
    r = random.Random(11)
    make = lambda n, k: " ".join("".join(r.choice("aeionrst") for _ in range(k)) for _ in range(n))
    passage = make(51, 4)
    rows = [(i, make(80, 5) + "\n" + passage + "\n" + make(80, 5)) for i in range(3)] + [(9, make(150, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x.text for x in corpus_pipeline.repeated_passages(spark, docs, str(tmp_path)).collect()}
    assert len(passage) < 400 and all(passage not in out[i] and len(out[i]) < len(rows[i][1]) - 200 for i in range(3))
    assert out[9] == rows[3][1]
