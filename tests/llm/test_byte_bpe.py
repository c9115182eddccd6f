import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from pairlift.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    rng = random.Random(2)
    parts = ["word", " ", "  ", "\n", "\n\n", "'s", "12", "345", "ä", "你好", "🙂", "...", "a" * 90, " " * 70, "\t", "\xa0", "don't", "\x1c", "x" * 40 + " "]
    return ["".join(rng.choices(parts, k=rng.randint(1, 400))) for _ in range(60)] + ["a" * 5000, " " * 3000, "\n" * 999 + "b", ("a" * 700 + " ") * 5]


def expand(rows):
    return sorted((str(r["doc_id"]), r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in rows)


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1024), (64, 16), (40, 40), (7, 1)])
def test_ids_and_round_trip(make_docs, edge_pairs, encoding, chunk, overlap):
    pairs = [*edge_pairs, *enumerate(hard_texts(), 1000)]
    if chunk < 40:
        pairs = [(i, (t or "")[:600]) for i, t in pairs]
    coded = byte_bpe.encode(make_docs(pairs), PATH, P.PATTERN, chunk_chars=chunk, overlap_chars=overlap)
    rows = byte_bpe.decode(coded, PATH, P.PATTERN).collect()
    want = []
    for doc_id, text in pairs:
        ids = encoding.encode_ordinary(text or "")
        want.append((str(doc_id), len(ids), ids, (text or "").encode()))
    assert expand(rows) == sorted(want)


def test_pieces_meet_in_overlaps():
    text = " ".join(f"some{i} words, and 12{i} more" for i in range(200))
    chunks = []
    for at in range(0, len(text) - 30, 100):
        part = text[at : at + 130]
        chunks.append((at, part, [at + s for s in byte_bpe.pre_token_starts(part, P.PATTERN)]))
    pieces = list(byte_bpe.stitched(chunks, P.PATTERN))
    assert "".join(pieces) == text and len(pieces) == len(chunks)


def test_empty_table(make_docs):
    assert byte_bpe.encode(make_docs([]), PATH, P.PATTERN).collect() == []


def test_bad_overlap(make_docs):
    with pytest.raises(ValueError):
        byte_bpe.encode(make_docs([]), PATH, P.PATTERN, chunk_chars=10, overlap_chars=11)
