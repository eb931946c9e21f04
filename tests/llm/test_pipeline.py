import hashlib
import random

import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidemark.llm import quality  # noqa: E402
from tidemark.llm.common import read_table, stored, work_folder  # noqa: E402
from tidemark.llm.near_dedup import Threshold  # noqa: E402
from tidemark.llm.pii import masked  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def corpus(folder, spark, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def small(seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(500)]
    good = [" ".join(rng.choices(words, k=40)) for _ in range(60)]
    good[5] += " mail me at some.body@example.org"
    good[7] = good[6]
    bad = ["$$$ ### !!! " * 20 + str(i) for i in range(30)]
    texts = [*good, *bad]
    rows = [(i, t, "en", rng.choice("abc"), len(t)) for i, t in enumerate(texts)]
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (None, good[8], "en", "a", 1)]
    return rows, [(i, int(i < 60), 0) for i in range(90)]


def test_stages_decide_and_keep_the_columns(spark, tmp_path):
    rows, labels = small()
    sf = corpus(tmp_path, spark, rows, labels)
    docs, folder, seen = read_table(spark, sf, "documents"), work_folder(spark), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), folder, name)
        seen[name] = docs.collect()
        if name != "encode":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "encode"]
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert not ids("quality") & set(range(60, 90)) and set(range(60)) <= ids("quality")
    assert ids("quality") - ids("near_duplicates") == {7, None}
    assert {r.doc_id: r.text for r in seen["personal_data"]} == {r.doc_id: masked(r.text) for r in seen["near_duplicates"]}
    assert "<EMAIL>" in next(r.text for r in seen["personal_data"] if r.doc_id == 5)
    assert ids("mix") <= ids("personal_data")
    library = sentencepiece.SentencePieceProcessor(model_file=f"{corpus_pipeline.TOKENIZERS}/piece_bpe_32k.model")
    texts = {r.doc_id: r.text or "" for r in seen["mix"]}
    assert len(seen["encode"]) == len(seen["mix"]) and all(r.round_trip for r in seen["encode"])
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in seen["encode"])


def test_run_equals_the_stages_and_reruns_agree(spark, tmp_path):
    sf = corpus(tmp_path, spark, *small(2))
    digest = lambda: hashlib.sha256(str(sorted(map(str, corpus_pipeline.run(spark, sf).collect()))).encode()).hexdigest()
    assert digest() == digest()


def test_an_empty_corpus(spark, tmp_path):
    assert corpus_pipeline.run(spark, corpus(tmp_path, spark, [], [])).count() == 0


def test_similarity_and_threshold_are_the_agreed_ones():
    assert corpus_pipeline.SIMILAR == Threshold(80, 100) and quality.THRESHOLD == 0.3
