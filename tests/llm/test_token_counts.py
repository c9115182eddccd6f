import random

import public_tokenizers as P
import pytest

from pairlift.llm import token_counts as tc

PATH = P.path("piece_bpe_32k.model")


def library_counts(pieces, texts):
    """The same vocabulary in the tokenizers library, which keeps whole paths."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.Unigram(list(pieces.scores), unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.fixture(scope="module")
def pieces():
    return tc.Pieces.of_sentencepiece(PATH)


def hard_texts():
    rng = random.Random(8)
    parts = ["word", " ", "  ", "\n", "▁", "ä", "你好", "🙂", "zzzzqqq", "12", "<0x41>", "</s>", "ing", "the", "\t", "é", "᚛", "x" * 70]
    return ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(400)] + ["", " ", "   ", "▁", " a", "a "]


def test_against_library(make_docs, edge_pairs, pieces):
    pairs = [*edge_pairs, *enumerate(hard_texts(), 1000)]
    rows = tc.token_counts(make_docs(pairs), PATH).collect()
    want = library_counts(pieces, [t or "" for _, t in pairs])
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted((str(i), n) for (i, _), n in zip(pairs, want, strict=True))


def test_ties_go_to_the_earlier_start():
    scores = (("<unk>", -30.0), *((f"<0x{b:02X}>", -30.0) for b in range(256)), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abb", -3.0), ("▁a", -2.0), ("bb", -2.0))
    pieces = tc.Pieces(scores)
    counter = tc.Counter(pieces)
    import pyarrow as pa

    texts = ["ab", "abb", "abab", "abbabb", "b", "bbb", "xab", "axxb"]
    assert counter.texts(pa.array(texts)).tolist() == library_counts(pieces, texts)


def test_forgetting_changes_nothing(monkeypatch, pieces):
    import pyarrow as pa

    monkeypatch.setattr(tc, "KEEP_SEGMENTS", 3)
    texts = [t for t in hard_texts() if t]
    assert tc.Counter(pieces).texts(pa.array(texts)).tolist() == library_counts(pieces, texts)


def test_empty_table(make_docs):
    assert tc.token_counts(make_docs([]), PATH).collect() == []
