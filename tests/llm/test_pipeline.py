"""The pipeline, stage by stage, against brute force on small tables."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from fieldreports.llm import packing, quality_rules, source_mix
from fieldreports.llm.common import store
from tests.conftest import SF_SMALL

from .cases import base_counts, base_spans, near_groups, words


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near duplicates", "secret scans", "source mix", "packing"]

    good = store(stages["quality rules"](spark, docs, SF_SMALL), "t")
    assert good.dtypes == docs.dtypes
    kept = {r[0] for r in rows_of(good)}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    for i, text, _, _ in rows_of(docs):
        c = base_counts(text)
        failed = c[0] < quality_rules.LEAST_WORDS or 100 * c[4] > quality_rules.MOST_REPEATED_PERCENT * c[0]
        assert not (failed and i in kept)
        if not failed and i in labels:
            assert (i in kept) == bool(labels[i])

    single = store(stages["near duplicates"](spark, good, SF_SMALL), "t")
    groups = near_groups(rows_of(good))
    assert sorted(r[0] for r in rows_of(single)) == sorted({g[1] for g in groups})

    clean = store(stages["secret scans"](spark, single, SF_SMALL), "t")
    before, after = ({r[0]: r[1] for r in rows_of(d)} for d in (single, clean))
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert base_spans(after[i]) == []
        if not base_spans(text) and "[secret]" not in after[i]:
            assert after[i] == text

    mixed = store(stages["source mix"](spark, clean, SF_SMALL), "t")
    assert mixed.dtypes == docs.dtypes
    taken = {r["source"]: r["n"] for r in source_mix.mix(clean).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = Counter()
    for _, text, _, source in rows_of(mixed):
        got[source] += len(words(text))
    assert got == Counter({s: n for s, n in taken.items() if n})

    packed = stages["packing"](spark, mixed, SF_SMALL).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in rows_of(mixed))
    assert len({r["sequence_id"] for r in packed}) <= 1.02 * sum(r["length"] for r in packed) / packing.CAPACITY + 1


def test_run_gives_the_rows_of_its_stages(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_stages_take_hard_cases_and_empty_tables(spark, hard_dir, empty_dir):
    for base in (hard_dir, empty_dir):
        docs = spark.read.parquet(f"{base}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = store(stage(spark, docs, base), "t")
            assert name == "packing" or out.columns == docs.columns
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
    assert corpus_pipeline.run(spark, hard_dir).count() >= 0
