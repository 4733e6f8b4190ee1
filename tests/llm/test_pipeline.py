import os
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from farelane.llm import decontam, near_dedup
from farelane.llm.common import maybe_in

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole, first = docs, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "stage")
        assert docs.schema == whole.schema, name
        assert docs.count() <= before * 2
        if name == "benchmark decontamination":
            first = docs
    assert near_dedup.cluster(first).where("not kept").count() == 0
    assert decontam.contaminated(first, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas().sort_values("start")
    assert sorted(out.doc_id) == sorted(r["doc_id"] for r in docs.collect()) and out.doc_id.is_monotonic_increasing
    assert (out.start.to_numpy()[1:] == (out.start + out.n_tokens).to_numpy()[:-1]).all()


def test_run_gives_the_last_stage(spark):
    a, b = (corpus_pipeline.run(spark, SF).toPandas().sort_values("start", ignore_index=True) for _ in range(2))
    assert a.equals(b) and len(a)


def test_workers_of_the_filter_stages_load_no_pandas():
    """Some 45 MB a worker that no kernel of these stages uses; common's filter of keys runs on Arrow as well."""
    code = "import sys, farelane.llm.quality, farelane.llm.near_dedup, farelane.llm.decontam, farelane.llm.sstable; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).returncode == 0


def test_keys_that_a_column_holds_pass_its_filter(spark):
    keys = spark.createDataFrame([(k * k * 7919 - 5,) for k in range(50)], "k long")
    rows = spark.range(-100, 100).select(F.col("id").cast("long").alias("k")).union(keys)
    got = {r["k"] for r in rows.where(maybe_in(keys, "k")(F.col("k"))).collect()}
    assert {r["k"] for r in keys.collect()} <= got and len(got) < 150
