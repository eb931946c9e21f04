import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import pieces
from tidemark.llm.common import text_of, tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(library, texts):
    ids, counts = pieces.encode_batch(PATH, texts)
    expected = library.encode(texts)
    for text, got, want in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), expected):
        assert got.tolist() == want, repr(text)
    assert pieces.decode_batch(pieces.load_pieces(PATH), ids, counts) == [library.decode(e) for e in expected]


def test_random_texts_equal_the_library(library):
    random.seed(3)
    parts = ["a", "b", " ", "  ", "▁", "é", "\n", "\t", "the", "ing", "0", "日", "😀", "́", "\x00", "<s>", "<0x0A>", "--", "==", "　", "�"]
    check(library, ["".join(random.choices(parts, k=random.randint(0, 50))) for _ in range(4000)])
    check(library, ["".join(random.choices("eta ins", k=random.randint(0, 300))) for _ in range(500)])


def test_long_words_and_runs_equal_the_library(library):
    random.seed(4)
    check(library, ["a" * 700, " " * 700 + "x", "=" * 900, "日本語" * 300, "".join(random.choices("etains", k=5000)), " " * 40, "ab" * 400, "-" * 513])


def test_rounds_and_heap_agree():
    model = pieces.load_pieces(PATH)
    random.seed(6)
    for _ in range(300):
        word = np.array([model.char_symbol[ord(c)] for c in random.choices("▁ethanios=-", k=40)], dtype=np.int64)
        rounds, _ = pieces._merge_rounds(model, word.copy(), np.array([40]))
        assert rounds.tolist() == pieces._merge_heap(model, word).tolist()


def test_any_ids_decode_like_the_library(library):
    random.seed(7)
    lists = [[random.randrange(3, 32_000) if random.random() < 0.5 else random.randrange(3, 259) for _ in range(random.randint(0, 20))] for _ in range(3000)]
    lists += [[0], [1, 5], [], [1, 2], [259, 300]]
    flat = np.array([i for x in lists for i in x])
    assert pieces.decode_batch(pieces.load_pieces(PATH), flat, np.array([len(x) for x in lists])) == [library.decode(x) for x in lists]


def test_columns_with_nulls_repeats_and_clashing_names(spark, library):
    texts = [None, "", "one  two", "one  two", "x" * 50_000]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, ids int")
    rows = df.select(pieces.encode_ids(text_of("text"), PATH).alias("e"), "ids").withColumn("d", pieces.decode_ids(F.col("e"), PATH)).collect()
    assert [r.e for r in rows] == [library.encode(t or "") for t in texts]
    assert [r.d for r in rows] == [t or "" for t in texts] and {r.ids for r in rows} == {1}
    assert df.limit(0).select(pieces.encode_ids(text_of("text"), PATH)).count() == 0


def test_checked_encoding_equals_the_library(spark, library):
    texts = ["a b", None, "", "日本\n the ▁ x", "words and more " * 60_000, "a b", "\x00 ￼", "x" * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(2)
    got = {r.n: r.e for r in rows.select("n", pieces.encode_checked(F.col("text"), PATH).alias("e")).collect()}
    for n, text in enumerate(texts):
        want = library.encode(text or "")
        assert got[n].ids == want and got[n].round_trip == (library.decode(want) == (text or ""))
    assert not got[3].round_trip and got[4].round_trip
    empty = rows.where("n < 0").select(pieces.encode_checked(F.col("text"), PATH).alias("e"))
    assert empty.count() == 0


def test_digests_equal_the_library(spark, library):
    texts = [None, "", "one  two", "one  two", "x" * 50_000, "日本 \n😀", "<s>"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int")
    found = df.select("n_tokens", pieces.encode_digests(text_of("text"), PATH).alias("e")).select("e.*").collect()
    for text, row in zip(texts, found):
        ids = library.encode(text or "")
        joined = ",".join(map(str, ids)).encode()
        decoded = library.decode(ids).encode()
        assert tuple(row) == (len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest())
