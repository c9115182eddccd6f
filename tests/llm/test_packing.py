import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from pairlift.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def tokens(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_bins(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [7, 4096])
def test_documents(make_docs, edge_pairs, capacity):
    rows = packing.pack_documents(make_docs(edge_pairs), PATH, capacity=capacity).collect()
    want = []
    for doc_id, text in edge_pairs:
        ids = tokens(text)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            cut = np.array(ids[start : start + capacity], "<u4").tobytes()
            want.append((str(doc_id), piece, start, len(cut) // 4, zlib.crc32(cut), cut))
    got = [(str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows]
    assert sorted(got) == sorted(want)
    n = check_bins(rows, capacity)
    total = sum(r["length"] for r in rows)
    assert n <= 1.3 * total / capacity + 1


def test_chunk_cache_can_be_emptied(edge_pairs):
    import pyarrow as pa

    tokenizer = packing.ChunkTokenizer(PATH, keep=2)
    for _ in range(2):
        for _, text in edge_pairs:
            (ids,) = tokenizer.encode(pa.array([text or ""], pa.string()))
            assert ids.tolist() == tokens(text)[:-1]


SPECIAL_TEXTS = [
    "end of one <|endoftext|> start", "<|startoftext|>A b.<|endoftext|>", "x<|endoftext|>y", "no <|ENDOFTEXT|> here", "both <|ENDOFTEXT|> and <|endoftext|>",
    "<|endoftext|", "plain text, twice.", "<|endoftext|><|endoftext|>\n<|endoftext|>",
]


def test_special_tokens_get_their_ids(make_docs):
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(make_docs(list(enumerate(SPECIAL_TEXTS))), PATH).collect()
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in rows}
    assert got == {i: [*default.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(SPECIAL_TEXTS)}
    assert 49407 in got[0] and 49407 not in got[3]


def unroll(patterns):
    return sorted(length for bin_, times in patterns for length in bin_ * times)


def test_patterns_use_every_piece_once():
    rng = np.random.default_rng(7)
    for capacity in (10, 100, 4096):
        lengths = rng.integers(1, capacity + 1, 3000)
        counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        patterns = packing.fill_patterns(counts, capacity)
        assert unroll(patterns) == sorted(lengths.tolist())
        assert all(sum(b) <= capacity for b, _ in patterns)


def test_two_pieces_replace_the_smallest():
    # Greedy: 60 + 30 leaves 10; 21 and 19 fill the 40 left beside 60 exactly.
    patterns = packing.fill_patterns({60: 1, 30: 1, 21: 1, 19: 1}, 100)
    assert patterns[0] == ([60, 21, 19], 1)


def test_patterns_do_not_grow_with_the_corpus():
    counts = {length: 1 + length % 5 for length in range(1, 513)}
    few = packing.fill_patterns(counts, 512)
    many = packing.fill_patterns({k: n * 1_000_000 for k, n in counts.items()}, 512)
    assert len(many) <= 512 * 7 and len(few) <= 512 * 7
    assert sum(t * sum(b) for b, t in many) == 1_000_000 * sum(k * n for k, n in counts.items())


def test_length_outside_capacity():
    with pytest.raises(ValueError):
        packing.fill_patterns({11: 1}, 10)


def test_empty_table(make_docs):
    assert packing.pack_documents(make_docs([]), PATH).collect() == []


def test_every_letter_before_a_mark_is_coded_as_by_the_tokenizer():
    """Some letters' normal forms end in a combining mark, which the tokenizer joins with punctuation."""
    import sys
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LN"]
    texts = [f"a{c}. b {c}, {c.upper()}!? x" for c in letters]
    got = packing.ChunkTokenizer(PATH).encode(pa.array(texts))
    want = plain.encode_batch(texts, add_special_tokens=False)
    assert all(g.tolist() == w.ids for g, w in zip(got, want, strict=True))
    assert "\u09df" in packing.joining_letters(plain) and "e" not in packing.joining_letters(plain)


class CountingCalls:
    """A tokenizer that notes how many inputs it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.inputs = tokenizer, 0

    def encode_batch_fast(self, inputs, **options):
        self.inputs += len(inputs)
        return self.tokenizer.encode_batch_fast(inputs, **options)


@pytest.mark.parametrize("closes", ["as it is", "none", "wrong"])
def test_plain_words_are_encoded_together(closes):
    import random

    import pyarrow as pa

    rng = random.Random(8)
    parts = ["the", "st", "ion", "ß", "äü", "é", "œ", "İ", "É", "'s", "'t", "12", ".", "of", "q", "x", "´", "ª", "÷", "日本", "</w>", "i̇"]
    words = ["".join(rng.choice(parts[:6]) for _ in range(rng.randint(1, 6))) for _ in range(5000)]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(2000)]
    texts = [" ".join(words), *words[:50], "", " ", *(" ".join(mixed[i : i + 40]) for i in range(0, 2000, 40)), " ".join(words[::-1])]
    tokenizer = packing.ChunkTokenizer(PATH)
    calls = tokenizer.tokenizer = CountingCalls(tokenizer.tokenizer)
    if closes == "none":
        tokenizer.closes = None
    elif closes == "wrong":
        tokenizer.closes = ~tokenizer.closes
    want = [np.array(e.ids) for e in tokenizer.whole.encode_batch(texts, add_special_tokens=False)]
    first = tokenizer.encode(pa.array(texts[:51]))
    together = calls.inputs
    got = [*first, *tokenizer.encode(pa.array(texts[51:]))]
    assert all(g.tolist() == w.tolist() for g, w in zip(got, want, strict=True))
    if closes == "as it is":
        assert together < 10 < len(set(words))
