import corpus_pipeline
from tests.conftest import SF
from tests.llm.conftest import junk, prose
from tripfold.llm.common import shingle_hashes


def test_stages(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
        kept.append(out.count())
        docs = out
    assert 0 < kept[2] <= kept[1] <= kept[0] and kept[4] == kept[3]


def test_near_duplicates_leave_one_each(spark):
    out = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    sets = [set(shingle_hashes(r["text"], 5).tolist()) for r in out]
    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            assert not sets[i] or 100 * k < 80 * (len(sets[i]) + len(sets[j]) - k)


def test_odd_rows(spark, frame, tmp_path):
    """Null and repeated ids, null texts and sources: what each stage keeps and drops, row by row."""
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").orderBy("item_id").first()["text"]
    rows = [(i % 5 if i % 3 else None, prose(i, 80 + i), "en", ["a", None][i % 2], 9) for i in range(40)]
    odd = [(7, None, None, None, None), (7, "", "en", "a", 0), (None, " ", "en", "a", 1), (8, prose(3, 6000), "en", "a", 9), (None, leak, "en", "a", 9), (3, leak + " x", "en", "b", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows + odd + [rows[0], rows[1]], schema)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns and good.exceptAll(docs).isEmpty()
    once = sorted(map(tuple, stages["n-gram Jaccard join"](spark, docs, SF).collect()), key=str)
    left = rows + odd[:4] + [odd[5]]  # the benchmark passage with an id goes before the one without
    assert once == sorted(left, key=str)
    clean = sorted(map(tuple, stages["benchmark decontamination"](spark, spark.createDataFrame(left, schema), SF).collect()), key=str)
    assert clean == sorted(rows + odd[:4], key=str)
    mixed = stages["mixing sources to target weights"](spark, spark.createDataFrame(clean, schema), SF).collect()
    assert {tuple(r) for r in mixed} <= set(clean) and sum(r["doc_id"] is None for r in mixed) > 5
    ids = stages["token-ID output"](spark, spark.createDataFrame(clean, schema), SF)
    assert ids.count() == len(clean)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
