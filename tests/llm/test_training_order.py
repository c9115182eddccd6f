import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest

from pairlift.llm import training_order as to
from pairlift.workspace import scratch_path

PATH = P.path("word_bpe_49k.json")


@lru_cache
def _tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return tokenizer


def tokens(text):
    return [*_tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_feistel_is_a_keyed_permutation(n):
    one = to.feistel(np.arange(n), n, 5)
    assert sorted(one.tolist()) == list(range(n))
    assert one.tolist() == [int(to.feistel(np.array([i]), n, 5)[0]) for i in range(n)]
    if n >= 64:
        assert (one != to.feistel(np.arange(n), n, 6)).mean() > 0.8
        assert abs(np.corrcoef(one, np.arange(n))[0, 1]) < 0.4


def test_shards(spark, make_docs, edge_pairs):
    docs = make_docs(edge_pairs, parts=1)
    order = [(r["doc_id"], r["text"]) for r in docs.collect()]
    shards, index = to.materialise(docs, PATH, scratch_path(spark, "shards"), key=99, length=64, shard_records=10)
    coded = [tokens(text) for _, text in order]
    stream = [t for ids in coded for t in ids]
    owner = [k for k, ids in enumerate(coded) for _ in ids]
    rows = {r["slot"]: r for r in shards.read(spark).collect()}
    n = -(-len(stream) // 64)
    assert sorted(rows) == list(range(n)) and shards.n_sequences == n
    slots = to.feistel(np.arange(n), n, 99)
    of_slot = {r["slot"]: r for r in index.collect()}
    for k, slot in enumerate(slots.tolist()):
        want = np.array(stream[64 * k : 64 * k + 64], "<u2").tobytes()
        assert bytes(rows[slot]["ids"]) == want and rows[slot]["n_ids"] == len(want) // 2
        assert of_slot[slot]["ids_crc32"] == zlib.crc32(want)
        assert of_slot[slot]["doc_ids"] == [order[d][0] for d in dict.fromkeys(owner[64 * k : 64 * k + 64])]
    late = shards.read(spark, 25).collect()
    assert sorted(r["slot"] for r in late) == list(range(25, n))


def test_place_finds_the_record(spark, make_docs, edge_pairs):
    import glob

    shards, _ = to.materialise(make_docs(edge_pairs), PATH, scratch_path(spark, "shards"), key=1, length=32, shard_records=7)
    rows = {r["slot"]: r for r in shards.read(spark).collect()}
    for slot in (0, 6, 7, 20, shards.n_sequences - 1):
        folder, at = shards.place(slot)
        (file,) = glob.glob(folder.removeprefix("file:") + "/part-*")
        with open(file, "rb") as data:
            data.seek(at)
            record = data.read(shards.stride)
        assert int.from_bytes(record[:8], "little") == slot and record.endswith(b"\n")
        assert record[12 : 12 + 2 * rows[slot]["n_ids"]] == bytes(rows[slot]["ids"])


def test_empty_table(spark, make_docs):
    shards, index = to.materialise(make_docs([]), PATH, scratch_path(spark, "shards"), key=1)
    assert shards.n_sequences == 0 and shards.read(spark).collect() == [] and index.collect() == []
