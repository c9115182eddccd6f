import hashlib
import re
from collections import defaultdict

import pytest

from pairlift.llm import exact_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute(pairs):
    groups = defaultdict(list)
    for doc_id, text in pairs:
        groups[SPACE.sub("", text or "")].append((len(text or ""), doc_id))
    out = []
    for bare, rows in groups.items():
        best = min(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        first = True
        for row in sorted(rows, key=lambda r: (r != best)):
            out.append((row[1], best[1], len(rows), first, hashlib.sha256(bare.encode()).hexdigest()))
            first = False
    return out


def key(row):
    return tuple((v is None, v) for v in row)


COLS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("block_bytes", [3, 64, 4096])
def test_against_brute_force(make_docs, edge_pairs, block_bytes):
    got = exact_dedup.exact_duplicates(make_docs(edge_pairs), block_bytes=block_bytes).select(*COLS).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(edge_pairs), key=key)


def test_shared_routes_are_told_apart_by_content(make_docs, edge_pairs):
    """With 3-bit routes nearly all blocks share theirs; identities stay exact."""
    from pyspark.sql import functions as F

    from pairlift.llm.common import id_and_text

    tagged = id_and_text(make_docs(edge_pairs)).withColumn("uid", F.monotonically_increasing_id())
    ident = exact_dedup.identities(tagged, block_bytes=16, route_bits=3).collect()
    by_name, by_sha = defaultdict(set), defaultdict(set)
    for r in ident:
        by_name[r["level"], r["name"]].add(r["text_sha256"])
        by_sha[r["text_sha256"]].add((r["level"], r["name"]))
    assert len(ident) == len(edge_pairs)
    assert all(len(v) == 1 for v in [*by_name.values(), *by_sha.values()])


def test_empty_table(make_docs):
    assert exact_dedup.exact_duplicates(make_docs([])).collect() == []


def test_drop_keeps_all_columns(make_docs, edge_pairs):
    docs = make_docs(edge_pairs)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=key)
    want = {SPACE.sub("", t or "") for _, t in edge_pairs}
    assert len(got) == len(want) and {SPACE.sub("", t or "") for _, t in got} == want
