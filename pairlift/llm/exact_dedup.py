"""Exact duplicates by deterministic block naming.

A text without its white space is cut into fixed-size blocks. Sorting the distinct blocks
gives each an integer name; then adjacent names are paired and the distinct pairs sorted
and named again, until each document has one name. Two documents that needed the same
number of rounds have equal names exactly if their texts are equal: names stand for
contents that were compared, never for hashes.

Texts are written and shuffled once, as blocks. A hash only routes a block to its name:
hashes that turn out to have two different blocks are resolved by the blocks themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairlift.llm.common import fresh_name, id_and_text, slices, staged

BLOCK_BYTES = 4096
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
# Names of blocks whose hash is shared start here, above all other names.
SHARED_FROM = 1 << 62
NO_NAME = -1

_BLOCKS = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("n_points", pa.int64()), ("text_sha256", pa.string()),
     ("n_blocks", pa.int64()), ("pos", pa.int64()), ("block", pa.binary())]
)
_BLOCKS_DDL = "uid long, doc_id long, n_points long, text_sha256 string, n_blocks long, pos long, block binary"


def _cut(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[tuple] = []
            texts = part.column("text").cast(pa.binary()).to_pylist()
            heads = zip(*(part.column(c).to_pylist() for c in ("uid", "doc_id", "n_points")), strict=True)
            for (uid, doc_id, n_points), text in zip(heads, texts, strict=True):
                bare = text.translate(None, WHITE_SPACE)
                digest = hashlib.sha256(bare).hexdigest()
                starts = range(0, max(1, len(bare)), block_bytes)
                out += [(uid, doc_id, n_points, digest, len(starts), i, bare[s : s + block_bytes]) for i, s in enumerate(starts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)

    return run


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of ``docs`` (uid, doc_id, text): its place, and its document's facts."""
    rows = docs.select("uid", "doc_id", F.char_length("text").cast("long").alias("n_points"), "text")
    return rows.mapInArrow(_cut(block_bytes), _BLOCKS_DDL)


def _names(distinct: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Integer names of distinct rows: in each shuffle partition, which equal contents always reach together, by sorted place."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id() + F.lit(start))


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """(uid, pos, n_blocks, name) of all blocks; the text is shuffled once, after equal blocks of a task became one."""
    places = blocks.select("uid", "pos", "n_blocks", "route")
    names = staged(_names(blocks.select("route", "block").distinct(), ["block"]).select("route", "name"), "block-names")
    # Written before it is joined back: then a block that very many texts share can be split.
    owners = staged(names.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("name")), "block-owners")
    plain = places.join(owners.filter("n = 1").select("route", "name"), "route")
    cols = ["uid", "pos", "n_blocks", "name"]
    # As a rule no two blocks share a route; then the text isn't shuffled again to find that out.
    routes = staged(owners.filter("n > 1").select("route"), "shared-routes")
    if routes.isEmpty():
        return plain.select(*cols)
    shared = blocks.join(routes, "route", "left_semi")
    shared_names = staged(_names(shared.select("route", "block").distinct(), ["block"], SHARED_FROM), "shared-block-names")
    by_block = shared.select("uid", "pos", "n_blocks", "route", "block").join(shared_names, ["route", "block"])
    return plain.select(*cols).unionByName(by_block.select(*cols))


def identities(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, route_bits: int = 64) -> DataFrame:
    """(uid, doc_id, n_points, text_sha256, level, name) of ``docs`` (uid unique, doc_id, text).

    Two rows have equal (level, name) exactly if their texts without white space are equal.
    ``route_bits`` shortens the routing hash (tests use it to get shared hashes).
    """
    route = F.shiftrightunsigned(F.xxhash64("block"), 64 - route_bits)
    blocks = staged(text_blocks(docs, block_bytes).withColumn("route", route), "blocks")
    rounds = (blocks.agg(F.max("n_blocks")).first()[0] or 1) - 1
    named = _name_blocks(blocks)
    done = [named.filter("n_blocks = 1").select("uid", F.lit(0).alias("level"), "name")]
    rest = named.filter("n_blocks > 1").select("uid", "pos", F.col("n_blocks").alias("n"), "name")
    for level in range(1, rounds.bit_length() + 1):
        half = rest.groupBy("uid", F.expr("pos div 2").alias("pos")).agg(
            F.expr("(max(n) + 1) div 2").alias("n"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NO_NAME)).alias("b"),
        )
        pairs = staged(half, "pairs")
        names = staged(_names(pairs.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        named = pairs.join(names, ["a", "b"]).select("uid", "pos", "n", "name")
        done.append(named.filter("n = 1").select("uid", F.lit(level).alias("level"), "name"))
        rest = named.filter("n > 1")
    name_of = done[0]
    for more in done[1:]:
        name_of = name_of.unionByName(more)
    facts = blocks.filter("pos = 0").select("uid", "doc_id", "n_points", "text_sha256")
    return staged(facts.join(name_of, "uid"), "identities")


def _rank(uid: Column, doc_id: Column, n_points: Column) -> Column:
    """The row with the greatest of these stays: longest text, then smallest id (null last), then first tag."""
    return F.struct(n_points.alias("n"), doc_id.isNotNull().alias("has"), F.bitwise_not(doc_id).alias("id"), F.bitwise_not(uid).alias("u"))


def groups(ident: DataFrame) -> DataFrame:
    """(uid, doc_id, keep_id, group_size, kept, text_sha256) from ``identities``."""
    best = ident.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(_rank(F.col("uid"), F.col("doc_id"), F.col("n_points"))).alias("best")
    )
    # Written before it is joined back, so that the rows of a very large group can be split.
    return ident.join(staged(best, "kept-rows"), ["level", "name"]).select(
        "uid",
        "doc_id",
        F.bitwise_not(F.col("best.id")).alias("keep_id"),
        "group_size",
        (F.bitwise_not(F.col("best.u")) == F.col("uid")).alias("kept"),
        "text_sha256",
    )


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Duplicate groups of texts that agree but for white space.

    One row per input row: doc_id, keep_id (the row that stays: most code points, then
    smallest doc_id), group_size, kept, text_sha256 of the text without white space.
    Null texts count as empty, and all texts without other characters are one group. A null
    doc_id ranks after all others. Of repeated rows, one is kept. No rows: no rows. Other
    columns are not looked at.
    """
    tagged = id_and_text(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    return groups(identities(tagged, block_bytes=block_bytes)).drop("uid")


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the kept row of each group only, all columns as they were.

    Null texts count as empty, and of all texts without other characters one row stays. Ties
    of length go to the smaller id, a null one last; of repeated rows one stays. Texts are
    read whole. No rows: no rows. Columns of any name pass through.
    """
    uid = fresh_name(docs.columns, "uid")
    tagged = staged(docs.withColumn(uid, F.monotonically_increasing_id()), "tagged")
    bare = id_and_text(tagged, id_col, text_col, uid)
    dropped = groups(identities(bare, block_bytes=block_bytes)).filter("not kept").select(F.col("uid").alias(uid))
    return tagged.join(dropped, uid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

