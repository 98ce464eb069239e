import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rillwork.llm import common, packing, private_data, simhash, toxicity
from rillwork.llm.common import stored, table
from rillwork.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, FOLDER, "documents")
    clean = stored(pipeline.drop_toxic(spark, docs, FOLDER))
    weights = toxicity.fit(docs, table(spark, FOLDER, "labels"))
    assert clean.where(toxicity.toxicity(spark, weights, F.col("text")) >= 0.5).count() == 0
    known = table(spark, FOLDER, "labels").where("toxic = 0").join(docs, "doc_id", "left_semi")
    assert known.join(clean, "doc_id", "left_anti").count() <= 0.02 * known.count()

    single = stored(pipeline.drop_near_duplicates(spark, clean, FOLDER))
    groups = simhash.near_duplicates(clean).where("doc_id = component_id").select("doc_id")
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(r[0] for r in groups.collect())

    masked = stored(pipeline.mask_private_data(spark, single, FOLDER))
    assert masked.columns == docs.columns and masked.count() == single.count()
    left = masked.select(F.explode(private_data.base_spans(F.col("text"))))
    assert left.where("col.no = 0").count() == 0

    mixed = stored(pipeline.mix_to_weights(spark, masked, FOLDER))
    assert mixed.columns == docs.columns
    most = mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 2

    packed = pipeline.pack_sequences(spark, mixed, FOLDER)
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert ends.where("n > 4096 or n <> m").count() == 0
    assert packed.where("piece = 0").count() == mixed.count()


def test_the_near_duplicate_stage_broadcasts_no_replicas(spark, monkeypatch):
    met, plain = [], simhash.smallest_reachable
    monkeypatch.setattr(simhash, "smallest_reachable", lambda nodes, links: met.append(links) or plain(nodes, links))
    rows = [(k, " ".join(f"w{k // 2}x{j}" for j in range(30))) for k in range(40)]
    kept = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == list(range(0, 40, 2))
    assert "Broadcast" not in met[0]._jdf.queryExecution().executedPlan().toString()


def test_names_of_stages():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "private_data", "mixing", "packing"]
    assert not re.search(r"except\s+ImportError", open(pipeline.__file__).read())


def test_a_worker_remembers_for_one_stage_at_a_time(spark):
    def held(tokenizer: str):
        def look(batches):
            for _ in batches:
                coder = packing.coder_of(tokenizer)
                common.kept(("features", 20), lambda: toxicity.Hasher(20))
                yield pa.RecordBatch.from_arrays([pa.array([len(common._kept)]), pa.array([coder is packing.coder_of(tokenizer)])], ["n", "same"])
        return look

    got = spark.range(1).mapInArrow(held(tokenizer_path()), "n long, same boolean").first()
    assert got.n == 1 and not got.same


def test_whole_texts_go_to_python_in_small_batches(spark):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows = spark.range(0, 5000, 1, 1).mapInArrow(count, "n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with common.small_batches(spark):
        assert max(r.n for r in rows.collect()) == common.BATCH
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
