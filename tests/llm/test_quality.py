import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.common import read_table
from tidemark.llm.queries import op8_quality_scores

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    marks = read_table(spark, SF, "labels").where("quality IS NOT NULL").select("doc_id", "quality")
    scored = op8_quality_scores(spark, SF)
    rows = scored.join(marks, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    y = np.array([r.quality for r in rows])
    s = np.array([r.score for r in rows])
    assert len(rows) > 300 and ((s >= 0) & (s <= 1)).all()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.98
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.98
    assert scored.count() == read_table(spark, SF, "documents").count()


def fit(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = quality.fit_quality(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    return [r[0] for r in d.select(quality.quality_score(d, model)).collect()]


def test_nulls_one_class_and_empty_tables(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, "words " * 50_000, None), (None, "x", "b"), (4, "same", "c"), (4, "same", "c")]
    assert len(fit(spark, docs, [])) == 6 and set(fit(spark, docs, [])) == {0.5}
    assert all(s > 0.99 for s in fit(spark, docs, [(3, 1), (4, 1), (None, 0), (1, None)]))
    assert fit(spark, [], [(1, 1)]) == []
    many = [(i, ("good words here " if i % 2 else "$$$ ### !!! ") * 5 + str(i), "x") for i in range(60)] + docs[:2]
    scores = fit(spark, many, [(i, i % 2) for i in range(60)])
    assert len(scores) == 62 and np.isfinite(scores).all()
    assert np.mean([s > 0.5 for s in scores[1:60:2]]) == 1.0 and np.mean([s < 0.5 for s in scores[0:60:2]]) == 1.0


def test_folds_follow_the_crc_of_the_id(spark):
    import zlib

    rows = spark.range(50).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in rows] == [zlib.crc32(str(r.id).encode()) % 5 == 0 for r in rows]
