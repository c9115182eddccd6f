"""Near duplicates by HyperMinHash.

A document's set is its distinct word shingles. One 64-bit hash of a shingle picks a bucket;
the bucket's smallest second hash is stored as a register: the count of its leading zeros
and the ``MANTISSA_BITS`` bits after the first one. Bands of registers are the join keys.

1. Equal sets become one class; only classes go on.
2. An empty register borrows, for the bands only, the first filled one in its own fixed random
   order of buckets, so that a register of two sets agrees as often as the sets are similar,
   however few shingles they have. Classes that share a band are candidates. In each band bucket all members are compared to
   one centre, the member that shares most bands with others: the text that the copies were
   made from, as a rule. So links grow with the members, not with their pairs.
3. Registers estimate each candidate's Jaccard similarity, corrected for the collisions of
   shortened registers; those below the threshold by five standard deviations go.
4. The rest is compared on the full sets, made again from the texts.
5. Linked classes become components. Where a bucket still holds more than one component, its
   members outside the largest one are strays of that one. Strays are compared, on full sets,
   to all members and all strays of it, in blocks of bounded size; only links that connect
   something new leave a block. So no link of a band pair is lost that a centre doesn't show.

With 32 bands of 5 registers a pair at similarity 0.85 shares no band with a probability of
about 7e-9, at 0.8 of about 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairlift.llm.common import Words, fresh_name, id_and_text, mix64, slices, staged, window_hashes
from pairlift.llm.components import components

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
# Expected collisions of two unrelated registers' mantissas, over 2 ** -MANTISSA_BITS (the HyperMinHash paper's constant).
COLLISIONS = 0.169919487159739
SIGMAS = 5.0
# Shingles of one side of a block in which strays are compared.
BLOCK_SHINGLES = 400_000

_SIGNED = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("registers", pa.binary()), ("text", pa.string())]
)
_SIGNED_DDL = "uid long, doc_id long, n_shingles long, set_key binary, registers binary, text string"


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles; a text of fewer words is one shingle, without words none."""
    words = Words(texts, lower=True)
    of_word = words.hashes()
    hashes, text = window_hashes(of_word[words.ids] if len(words.ids) else np.zeros(0, np.uint64), words.starts, width)
    bounds = np.searchsorted(text, np.arange(len(words.counts) + 1))
    out = []
    for i, n in enumerate(words.counts):
        if n >= width:
            out.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
        elif n:
            run = of_word[words.ids[words.starts[i] : words.starts[i + 1]]]
            out.append(window_hashes(run, np.array([0, n]), int(n))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (sets x REGISTERS, uint16): 0 for an empty bucket, else 1 + leading zeros and mantissa."""
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = ((flat & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(32)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(len(sets) * REGISTERS, none)
    np.minimum.at(least, row * REGISTERS + bucket.astype(np.int64), mix64(flat ^ np.uint64(0x9E3779B97F4A7C15)))
    top = least >> np.uint64(11)  # 53 bits, exact as doubles
    zeros = (53 - np.frexp(top.astype(np.float64))[1]).astype(np.uint64)
    rest = (top << (zeros + np.uint64(1))) & np.uint64((1 << 53) - 1)
    register = (zeros << np.uint64(MANTISSA_BITS)) + (rest >> np.uint64(53 - MANTISSA_BITS)) + np.uint64(1)
    return np.where(least == none, 0, register).astype(np.uint16).reshape(len(sets), REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of register rows, corrected for chance collisions, and how many registers it rests on."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    both = ((a > 0) & (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    ratio = n_a / np.maximum(n_b, 1)
    chance = COLLISIONS * both * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(same - chance, 0) / np.maximum(used, 1), used


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for part in slices(batches):
            sets = shingle_sets(part.column("text"), width)
            columns = [
                part.column("uid"),
                part.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([r.tobytes() for r in registers_of(sets)], pa.binary()),
                part.column("text"),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_SIGNED)

    return run


def densified(registers: np.ndarray) -> np.ndarray:
    """Register rows in which an empty register has the value of the first filled one in its own order of buckets."""
    order = np.array([np.random.default_rng([2017, i]).permutation(REGISTERS) for i in range(REGISTERS)])
    out = registers.copy()
    row, bucket = np.nonzero((registers == 0) & (registers > 0).any(axis=1)[:, None])
    for step in range(REGISTERS):
        if not len(row):
            break
        found = registers[row, order[bucket, step]]
        out[row, bucket] = found
        row, bucket = row[found == 0], bucket[found == 0]
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = densified(_register_rows(batch.column("registers"))).reshape(-1, BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), signs.shape[:2])
        for k in range(ROWS):
            key = mix64(key + (signs[:, :, k].astype(np.uint64) << np.uint64(16)) + np.uint64(1))
        filled = signs.any(axis=2)
        cids = np.broadcast_to(batch.column("cid").to_numpy()[:, None], filled.shape)
        yield pa.RecordBatch.from_arrays([pa.array(key[filled].view(np.int64)), pa.array(cids[filled])], names=["band", "cid"])


def _register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            guess, used = estimate(*(_register_rows(batch.column(c)) for c in ("r_a", "r_b")), n_a, n_b)
            slack = SIGMAS * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
            keep = (guess >= threshold - slack) & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(width: int, percent: int):
    """Rows come sorted by ``b``, so that the set of a centre is made once for all rows that follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for whole in batches:
            for part in slices([whole], "text_a"):
                keep = []
                centres = part.column("b").to_pylist()
                for i, (b, own) in enumerate(zip(centres, shingle_sets(part.column("text_a"), width), strict=True)):
                    if b != last:
                        last, last_set = b, shingle_sets(part.column("text_b").slice(i, 1), width)[0]
                    common = len(np.intersect1d(own, last_set, assume_unique=True))
                    keep.append(bool(common) and 100 * common >= percent * (len(own) + len(last_set) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids that are similar enough on their full sets, as a written table."""
    side = lambda s: classes.select(F.col("cid").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(percent / 100), "a long, b long")
    likely = staged(likely, "likely")
    text = lambda s: texts.select(F.col("uid").alias(s), F.col("text").alias(f"text_{s}"))
    full = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b").sortWithinPartitions("b")
    return staged(full.mapInArrow(_confirm(width, percent), "a long, b long"), "verified")


def _star_pairs(shared: DataFrame) -> DataFrame:
    """Each bucket's members with its centre, every pair once."""
    fame = staged(shared.groupBy("cid").agg(F.sum("size").alias("fame")), "fame")
    famed = shared.join(fame, "cid")
    centre = famed.groupBy("band").agg(F.max(F.struct("fame", F.bitwise_not("cid").alias("c"))).alias("best"))
    centre = staged(centre.select("band", F.bitwise_not(F.col("best.c")).alias("b")), "centres")
    return shared.join(centre, "band").filter("cid <> b").select(F.col("cid").alias("a"), "b").distinct()


def _new_links(of_x: list[int], sets: list[np.ndarray], roots: list[int], is_y: list[bool], percent: int) -> Iterator[tuple[int, int]]:
    """Links (positions) between the sets of ``of_x`` and all of ``is_y``, but for those inside what is connected already."""
    y = [i for i, flag in enumerate(is_y) if flag]
    flat = np.concatenate([sets[i] for i in y])
    size = np.array([len(sets[i]) for i in y])
    owner = np.repeat(np.arange(len(y)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    parent = {r: r for r in roots}

    def root(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    for i in of_x:
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        common = np.bincount(owner[at], minlength=len(y))
        for k in np.nonzero((common > 0) & (100 * common >= percent * (len(sets[i]) + size - common)))[0]:
            r, other = root(roots[i]), root(roots[y[k]])
            if r != other:
                parent[other] = r
                yield i, y[k]


def _compare_blocks(width: int, percent: int):
    """Rows come sorted by block; a block's rows may be spread over batches."""

    def links(part: pa.Table) -> pa.RecordBatch:
        cids = part.column("cid").to_pylist()
        sets = [s for piece in slices(part.combine_chunks().to_batches()) for s in shingle_sets(piece.column("text"), width)]
        of_x = [i for i, flag in enumerate(part.column("is_x").to_pylist()) if flag]
        found = list(_new_links(of_x, sets, part.column("root").to_pylist(), part.column("is_y").to_pylist(), percent)) if of_x else []
        return pa.RecordBatch.from_arrays([pa.array([cids[f[k]] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("main", "bx", "by")), strict=True))
            start = 0
            for stop in range(1, len(keys) + 1):
                if stop < len(keys) and keys[stop] == keys[start]:
                    continue
                if keys[start] != now and held:
                    yield links(pa.Table.from_batches(held))
                    held = []
                now = keys[start]
                held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _stray_links(shared: DataFrame, roots: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that connect components of one band bucket, as a written table (see step 5 above)."""
    root_of = classes.select("cid", F.col("n_shingles").alias("n")).join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
    root_of = staged(root_of.select("cid", "n", F.coalesce("root", "cid").alias("root")), "roots")
    found = staged(shared.select("band", "cid").join(root_of, "cid"), "rooted-bands")
    sizes = found.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("band").agg(F.max(F.struct("size", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    main = staged(main.select("band", F.col("top.root").alias("main")), "main-roots")
    strays = found.join(main, "band").filter("root <> main").select("main", "cid", "root", "n").distinct()
    strays = staged(strays.withColumn("is_x", F.lit(True)), "strays")
    members = root_of.withColumn("main", F.col("root")).join(strays.select("main").distinct(), "main", "left_semi")
    rows = strays.unionByName(members.withColumn("is_x", F.lit(False)).select(*strays.columns))
    blocks = lambda total: F.ceil(total / BLOCK_SHINGLES).cast("int")
    grid = rows.groupBy("main").agg(blocks(F.sum(F.when(F.col("is_x"), F.col("n")))).alias("nx"), blocks(F.sum("n")).alias("ny"))
    rows = rows.join(staged(grid, "grid"), "main")
    place = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    cols = ["main", "bx", "by", "cid", "root", "is_x", "is_y"]
    as_x = rows.filter("is_x").withColumn("bx", place("nx")).withColumn("by", every("ny")).withColumn("is_y", F.lit(False))
    as_y = rows.withColumn("by", place("ny")).withColumn("bx", every("nx")).withColumn("is_y", F.lit(True)).withColumn("is_x", F.lit(False))
    both = as_x.select(*cols).unionByName(as_y.select(*cols)).groupBy("main", "bx", "by", "cid", "root")
    both = both.agg(F.max("is_x").alias("is_x"), F.max("is_y").alias("is_y"))
    full = both.join(texts.withColumnRenamed("uid", "cid"), "cid").repartition("main", "bx", "by").sortWithinPartitions("main", "bx", "by", "cid")
    return staged(full.mapInArrow(_compare_blocks(width, percent), "a long, b long"), "stray-links")


def near_duplicate_groups(tagged: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """(uid, doc_id, n_shingles, component_id, kept) of ``tagged`` (uid unique, doc_id, text).

    component_id: the smallest doc_id of the documents reachable by links; kept: this is the
    row with that id (the first by uid, should several rows have it).
    """
    if not 1 <= percent <= 100 or width < 1:
        raise ValueError("percent must be 1 to 100 and width at least 1")
    signed = staged(tagged.select("uid", "doc_id", "text").mapInArrow(_sign(width), _SIGNED_DDL), "signed")
    filled = signed.filter("n_shingles > 0")
    # Minima are written before they are joined back, here and below: adaptive execution can split a hot key
    # only where both sides of the join come from a shuffle of their own.
    classes = staged(filled.groupBy("set_key").agg(F.min("uid").alias("cid")), "class-ids")
    member = staged(filled.select("uid", "set_key").join(classes, "set_key").select("uid", "cid"), "members")
    heads = member.filter("uid = cid").select("cid")
    classes = staged(signed.select(F.col("uid").alias("cid"), "n_shingles", "registers").join(heads, "cid"), "classes")
    bands = classes.select("cid", "registers").mapInArrow(_bands, "band long, cid long")
    bands = staged(bands, "bands")
    sizes = staged(bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "band-sizes")
    shared = staged(bands.join(sizes, "band"), "shared-bands")
    texts = signed.select("uid", "text")
    links = _verified(staged(_star_pairs(shared), "candidates"), classes, texts, width, percent)
    roots = components(links)
    more = _stray_links(shared, roots, classes, texts, width, percent)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    rooted = member.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("uid", F.coalesce("root", "cid").alias("root"))
    rows = staged(signed.select("uid", "doc_id", "n_shingles").join(rooted, "uid", "left"), "rooted")
    first = rows.filter("root is not null").groupBy("root").agg(
        F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("uid").alias("u"))).alias("best")
    )
    return rows.join(staged(first, "first-rows"), "root", "left").select(
        "uid",
        "doc_id",
        "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.bitwise_not(F.col("best.id"))).alias("component_id"),
        (F.col("root").isNull() | (F.bitwise_not(F.col("best.u")) == F.col("uid"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of texts whose ``width``-word shingle sets have at least ``percent`` % in common.

    One row per input row: doc_id, n_shingles, component_id, kept (one row of each component).
    Words are lower-cased for A-Z. Null and empty texts and texts without words have no
    shingles and are linked with nothing. Equal texts, and repeated rows, are linked. A null
    doc_id ranks after all others; a component of null ids only has a null component_id. No
    rows: no rows. Other columns are not looked at.
    """
    tagged = id_and_text(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    return near_duplicate_groups(tagged, width=width, percent=percent).drop("uid")


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest id, all columns as they were.

    Null and empty texts have no shingles and all stay. Of repeated rows, and of rows with the
    same smallest id, one stays; a null id comes after all others. Texts are read whole. No rows:
    no rows. Columns of any name pass through.
    """
    uid = fresh_name(docs.columns, "uid")
    tagged = staged(docs.withColumn(uid, F.monotonically_increasing_id()), "tagged")
    found = near_duplicate_groups(id_and_text(tagged, id_col, text_col, uid), width=width, percent=percent)
    dropped = staged(found.filter("not kept").select(F.col("uid").alias(uid)), "dropped")
    return tagged.join(dropped, uid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
