import random
import re
import zlib

import numpy as np
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packed_ids as pk
from tidemark.llm.chunks import ChunkTable
from tidemark.llm.common import tokenizer_file, work_folder

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 15, 16, 17, 31, 32])
@pytest.mark.parametrize("count", [0, 1, 8, 1003])
def test_packing_round_trip(bits, count):
    ids = np.random.default_rng(bits).integers(0, 2**bits, count, dtype=np.uint64).astype(np.uint32)
    data = pk.pack(ids, bits)
    assert len(data) == -(-count // 8) * bits and (pk.unpack(data, bits, count) == ids).all()


def test_random_access_reads_any_range(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50_257, 3 * pk.BLOCK + 17).astype(np.uint32)
    path = str(tmp_path / "s.bin")
    with pyarrow.fs.LocalFileSystem().open_output_stream(path) as sink:
        writer = pk.ShardWriter(sink, 50_257)
        writer.add([5, None], ids, np.array([10, len(ids) - 10]))
        writer.close()
    with pyarrow.fs.LocalFileSystem().open_input_file(path) as source:
        shard = pk.ShardReader(source)
        assert shard.bits == 16 and shard.n_ids == len(ids) and shard.doc_ids.tolist() == [5, pk.NO_ID]
        random.seed(2)
        for _ in range(200):
            a, b = sorted(random.choices(range(len(ids) + 1), k=2))
            assert (shard.ids(a, b) == ids[a:b]).all()


def test_ids_outside_the_vocabulary_are_refused(tmp_path):
    with pyarrow.fs.LocalFileSystem().open_output_stream(str(tmp_path / "s.bin")) as sink:
        with pytest.raises(ValueError):
            pk.ShardWriter(sink, 100).add([1], np.array([100]), np.array([1]))


def test_encoder_equals_the_library():
    random.seed(3)
    tokenizer = Tokenizer.from_file(PATH)
    parts = ["a", "b'll", " ", "  ", "'s", "é", "\n", "\t", "12", ".", "!!", "日", "😀", "the", "\x00", "<|endoftext|>", "\x1c", "\x85", "　", "\xa0", "​", "\r", " "]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(5000)] + ["", "x" * 20_000]
    ids, counts = pk.byte_bpe_encoder(PATH)()(texts)
    found = np.split(ids, np.cumsum(counts)[:-1])
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [f.tolist() for f in found] == expected
    encode = pk.byte_bpe_encoder(PATH)()  # one by one, most texts take the way by spaces
    by_spaces = [not re.search(r" (?!\S)|[\x1c-\x1f]", t) for t in texts]
    assert 200 < sum(by_spaces) < 4900
    assert [encode([t])[0].tolist() for t in texts] == expected
    tight = [t for t, ok in zip(texts, by_spaces) if ok]
    ids, counts = encode(tight)
    assert [f.tolist() for f in np.split(ids, np.cumsum(counts)[:-1])] == [e for e, ok in zip(expected, by_spaces) if ok]


def test_special_strings_are_encoded_as_the_library_does():
    text = "a <|endoftext|> b"
    ids, counts = pk.byte_bpe_encoder(PATH)()(["x y", text, "", text + "  z"])
    assert counts.tolist()[1] == 4 and 50_256 in ids
    tokenizer = Tokenizer.from_file(PATH)
    expected = [i for t in ["x y", text, "", text + "  z"] for i in tokenizer.encode(t, add_special_tokens=False).ids]
    assert ids.tolist() == expected


def test_a_full_chunk_table_keeps_what_is_used_often():
    calls = []

    def lengths(chunks):
        calls.extend(chunks)
        return np.array([len(c) for c in chunks], dtype=np.int64), np.ones(len(chunks), dtype=np.int64)

    table = ChunkTable(lengths, limit=50)
    for turn in range(40):
        texts = [["often"], [f"rare{turn}-{k}" for k in range(9)], ["also often", "often"], []]
        ids, counts = table.ids(texts)
        assert counts.tolist() == [1, 9, 2, 0] and ids.tolist() == [len(c) for t in texts for c in t]
        assert len(table.known) <= 50 + 11
    assert calls.count("often") == 1 and calls.count("also often") == 1
    table.ids([["x" * 5000]])
    table.ids([["often"]])
    assert table.chars <= 50 * 16


def documents(spark, rows):
    folder = f"{work_folder(spark)}/shards"
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, path string")
    manifest = pk.write_shards(docs, folder, pk.byte_bpe_encoder(PATH), 0, 50_257, shards=3)
    return [tuple(r) for r in pk.read_documents(manifest, folder).orderBy("start").collect()]


def test_documents_read_back_in_order(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 101, "some words " * (i % 9), 1, "p") for i in range(100)] + [(500, "long " * 40_000, 1, "p"), (None, None, None, None), (600, "", 0, ""), (3, "some words ", 1, "p")]
    got, at = documents(spark, rows), 0
    assert [r[0] for r in got] == [None] + sorted(r[0] for r in rows if r[0] is not None)
    texts = sorted((r[0] if r[0] is not None else -1, r[1] or "") for r in rows)
    expected = sorted((k, len(e := tokenizer.encode(t, add_special_tokens=False).ids + [0]), zlib.crc32(np.array(e, "<u4").tobytes())) for k, t in texts)
    assert sorted((r[0] if r[0] is not None else -1, r[2], r[3]) for r in got) == expected
    for r in got:
        assert r[1] == at
        at += r[2]


def test_an_empty_table(spark):
    assert documents(spark, []) == []
