"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to a few owners, rare terms to the first, the most common to
the last, so that each owner has about as many postings. Documents are indexed in slices of
some thousand. A bundle of items visits the owners one after another: at each it meets, by
cogroup on (slice, bundle), the owner's postings of the slice, adds the whole-number
contributions of its terms to its sparse accumulators (document place, score so far), and
goes on. After the last owner each slice gives its best documents of each item, of which the
first are chosen.

On the way an accumulator is dropped once it can't be among the first any more: the most that
its item's terms can still add in the slice leaves it below ``k`` others as they stand. So
rare terms first keep the bundles small, and results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.taskcontext import TaskContext

from pairlift.llm.common import Words, id_and_text, slices, staged
from pairlift.session import shuffle_partitions

OWNERS = 4
BUNDLE_ITEMS = 256
# Text of the items' terms that one pass over the documents looks for; more items make more passes.
TERM_BYTES = 16 << 20
NO_ID = -(1 << 63)

# ASCII letters and digits and all bytes of other characters make terms; only A-Z are lower-cased.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_BLOCK_DDL = "slice long, n_docs long, n_terms long, docs binary, sizes binary, terms binary, starts binary, places binary, counts binary"
_POSTINGS_DDL = "slice long, owner int, terms binary, starts binary, places binary, adds binary"
_BUNDLE_DDL = "slice long, bundle int, docs binary, left binary, held binary, places binary, scores binary"
_BUNDLE = pa.schema(
    [("slice", pa.int64()), ("bundle", pa.int32()), ("docs", pa.binary()), ("left", pa.binary()), ("held", pa.binary()), ("places", pa.binary()), ("scores", pa.binary())]
)
_FOUND_DDL = "item long, doc_id long, score long"
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(texts: pa.Array) -> Words:
    """Terms of texts without nulls: runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]].tobytes().translate(_LETTERS) if data is not None else b""
    moved = (offsets - offsets[0]).astype(np.int32)
    return Words(pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved.tobytes()), pa.py_buffer(raw)), lower=False)


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words = terms_of(part.column("text"))
        names = words.vocabulary.to_pylist()
        lists = [[names[i] for i in np.unique(words.ids[a:b])] for a, b in zip(words.starts[:-1], words.starts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("item_id"), pa.array(lists, pa.list_(pa.string()))], names=["uid", "item_id", "terms"])


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, item_id, terms): the distinct terms of each item that has any."""
    texts = id_and_text(items, id_col, text_col).withColumnRenamed("doc_id", "item_id")
    tagged = texts.select(F.monotonically_increasing_id().alias("uid"), "item_id", "text")
    return staged(tagged.mapInArrow(_distinct_terms, "uid long, item_id long, terms array<string>").where(F.size("terms") > 0), "items")


def _index(wanted: list[str]):
    """Postings of the wanted terms, a row per slice of documents that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(wanted, pa.string())
        number = TaskContext.get().partitionId() << 32
        for part in slices(batches):
            words = terms_of(part.column("text"))
            full = np.flatnonzero(words.counts)
            number += 1
            if not len(full):
                continue
            place = np.cumsum(words.counts > 0) - 1
            term = pc.fill_null(pc.index_in(words.vocabulary, value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)[words.ids]
            ours = np.flatnonzero(term >= 0)
            pairs, counts = np.unique(term[ours] * len(full) + place[words.texts_of_ids()[ours]], return_counts=True)
            terms, starts = np.unique(pairs // len(full), return_index=True)
            ids = pc.fill_null(part.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)[full]
            row = [number - 1, len(full), int(words.counts.sum()), ids.astype(np.int64).tobytes(), words.counts[full].astype(np.int64).tobytes(), terms.astype(np.int32).tobytes(),
                   np.append(starts, len(pairs)).astype(np.int32).tobytes(), (pairs % len(full)).astype(np.uint16).tobytes(), counts.astype(np.int32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=[c.split()[0] for c in _BLOCK_DDL.split(", ")])

    return run


def _held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each slice."""
    for batch in batches:
        for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int32)), pa.array(np.diff(np.frombuffer(starts, np.int32)).astype(np.int64))], names=["term", "df"])


def owners_of(df: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each term: bands of similar df, rare ones first, cut where the postings before them reach an owner's share."""
    band = np.array([int(x).bit_length() for x in df], np.int64)
    volume = np.bincount(band, weights=df, minlength=65)
    before = np.concatenate([[0.0], np.cumsum(volume)[:-1]])
    return np.minimum(owners - 1, (before / max(1.0, volume.sum()) * owners).astype(np.int64))[band].astype(np.int32)


class Plan:
    """What all tasks of a pass know: terms of the items by owner, and each term's weight."""

    def __init__(self, items: list[np.ndarray], df: np.ndarray, n_docs: int, n_terms: int, owners: int, bundle_items: int):
        self.items, self.n_docs, self.n_terms, self.bundle_items = items, n_docs, n_terms, bundle_items
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.owner = owners_of(df, owners)
        self.owners = owners
        self.bundles = -(-len(items) // bundle_items)

    def of_bundle(self, bundle: int) -> list[np.ndarray]:
        return self.items[bundle * self.bundle_items : (bundle + 1) * self.bundle_items]


def _weigh(plan: Plan):
    """The postings of each block by owner, counts turned into contributions; and, as owner -1, the block's facts for the bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _POSTINGS_DDL.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int64)
                terms, starts = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["starts"], np.int32).astype(np.int64)
                places, counts = np.frombuffer(row["places"], np.uint16), np.frombuffer(row["counts"], np.int32).astype(np.int64)
                m = 10 + 90 * sizes * plan.n_docs // plan.n_terms
                adds = np.repeat(plan.weights[terms], np.diff(starts)) * (1_000_000_000 * counts // (1000 * counts + 8 * m[places]))
                most = np.zeros(len(plan.weights), np.int64)
                if len(terms):
                    most[terms] = np.maximum.reduceat(adds, starts[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((row["slice"], pa.int64()), (-1, pa.int32()), (row["docs"], pa.binary()), (most.tobytes(), pa.binary()), (b"", pa.binary()), (b"", pa.binary()))], names=names)
                owner = plan.owner[terms]
                for o in np.unique(owner):
                    own = np.flatnonzero(owner == o)
                    at = np.concatenate([np.arange(starts[t], starts[t + 1]) for t in own])
                    ends = np.concatenate([[0], np.cumsum(np.diff(starts)[own])]).astype(np.int32)
                    values = (row["slice"], int(o), terms[own].tobytes(), ends.tobytes(), places[at].tobytes(), adds[at].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=names)

    return run


def _start(plan: Plan):
    """Bundles with empty accumulators, and how much each item can still get in the slice after each owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                most = np.frombuffer(row["starts"], np.int64)
                for bundle in range(plan.bundles):
                    by_owner = np.array([np.bincount(plan.owner[t], weights=most[t], minlength=plan.owners) for t in plan.of_bundle(bundle)])
                    left = np.ceil(by_owner.sum(axis=1, keepdims=True) - np.cumsum(by_owner, axis=1)) + 1
                    values = (row["slice"], bundle, row["terms"], left.astype(np.int64).tobytes(), np.zeros(len(left), np.int32).tobytes(), b"", b"")
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BUNDLE, strict=True)], schema=_BUNDLE)

    return run


def _visit(plan: Plan, owner: int, k: int, last: bool):
    """A bundle at an owner: add the owner's contributions; then pass on what can still win, or give the winners."""

    def run(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        if not bundles.num_rows:
            return (_FOUND if last else _BUNDLE).empty_table()
        state = bundles.to_pylist()[0]
        docs, items = np.frombuffer(state["docs"], np.int64), plan.of_bundle(state["bundle"])
        left = np.frombuffer(state["left"], np.int64).reshape(len(items), plan.owners)[:, owner]
        ends = np.concatenate([[0], np.cumsum(np.frombuffer(state["held"], np.int32))])
        places, scores = np.frombuffer(state["places"], np.uint16), np.frombuffer(state["scores"], np.int64)
        runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in postings.to_pylist():
            starts = np.frombuffer(part["starts"], np.int32)
            at, adds = np.frombuffer(part["places"], np.uint16), np.frombuffer(part["adds"], np.int64)
            runs |= {int(t): (at[a:b], adds[a:b]) for t, a, b in zip(np.frombuffer(part["terms"], np.int32), starts[:-1], starts[1:], strict=True)}
        held, kept = np.zeros(len(items), np.int32), []
        row = np.zeros(len(docs), np.int64)
        for i, terms in enumerate(items):
            row[:] = 0
            row[places[ends[i] : ends[i + 1]]] = scores[ends[i] : ends[i + 1]]
            for t in terms[plan.owner[terms] == owner]:
                if (posting := runs.get(int(t))) is not None:
                    row[posting[0]] += posting[1]
            some = np.flatnonzero(row)
            if len(some) > k:
                # k documents have at least this much already.
                bound = np.partition(row[some], len(some) - k)[len(some) - k]
                some = some[row[some] + (0 if last else left[i]) >= bound]
            held[i] = len(some)
            kept.append((some, row[some]))
        if not last:
            values = (state["slice"], state["bundle"], state["docs"], state["left"], held.tobytes(),
                      np.concatenate([p for p, _ in kept]).astype(np.uint16).tobytes(), np.concatenate([s for _, s in kept]).tobytes())
            return pa.table([pa.array([v], f.type) for v, f in zip(values, _BUNDLE, strict=True)], schema=_BUNDLE)
        out = []
        for i, (some, score) in enumerate(kept):
            ids = docs[some]
            first = np.lexsort((ids, ids == NO_ID, -score))[:k]
            out.append(np.stack([np.full(len(first), state["bundle"] * plan.bundle_items + i), ids[first], score[first]]))
        item, doc, score = np.concatenate(out, axis=1)
        return pa.table([pa.array(item), pa.array(doc, mask=doc == NO_ID), pa.array(score)], schema=_FOUND)

    return run


def _round(spark: SparkSession, texts: DataFrame, items: pa.Table, k: int, owners: int, bundle_items: int) -> DataFrame:
    """The best documents of items whose terms fit in every task."""
    lists = items.column("terms").combine_chunks()
    names = pc.unique(lists.flatten()).sort()
    numbers = pc.index_in(lists.flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    of_items = [numbers[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    blocks = staged(texts.mapInArrow(_index(names.to_pylist()), _BLOCK_DDL), "blocks")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = blocks.select("terms", "starts").mapInArrow(_held_by, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(names), np.int64)
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    plan = Plan(of_items, df, n_docs, n_terms, owners, bundle_items)

    index = staged(blocks.mapInArrow(_weigh(plan), _POSTINGS_DDL), "postings")
    bundles = index.where("owner = -1").select("slice", "terms", "starts").mapInArrow(_start(plan), _BUNDLE_DDL)
    spread = 2 * max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    on = ["slice", "bundle"]
    for owner in range(owners):
        last = owner == owners - 1
        postings = index.where(F.col("owner") == owner).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(plan.bundles - 1))))
        a, b = bundles.repartition(spread, *on), postings.repartition(spread, *on)
        bundles = a.groupBy(*on).cogroup(b.groupBy(*on)).applyInArrow(_visit(plan, owner, k, last), _FOUND_DDL if last else _BUNDLE_DDL)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = bundles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ids = spark.createDataFrame(pa.table([pa.array(range(len(items)), pa.int64()), items.column("item_id")], names=["item", "item_id"]))
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    owners: int = OWNERS,
    bundle_items: int = BUNDLE_ITEMS,
    term_bytes: int = TERM_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0 only.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document adds weight *
    (10^9 tf div (1000 tf + 8 m)) for each of the item's terms, once each, where m = 10 + (90 n N
    div L). N counts documents with terms, L all their terms, n the document's. Equal scores go
    to the smaller doc_id, a null one last.

    Null texts have no terms: such documents count nowhere and such items give no rows. A row
    that comes twice is two documents, or two items with rows of their own. Empty tables: no
    rows. Long texts are read whole. Other columns are not looked at. Items are read into the
    tasks in passes of at most about ``term_bytes`` of term text.
    """
    spark = docs.sparkSession
    asked = item_terms(items, item_id_col, item_text_col)
    size = asked.agg(F.coalesce(F.sum(F.aggregate("terms", F.lit(0), lambda n, t: n + F.octet_length(t) + 16)), F.lit(0))).first()[0]
    passes = max(1, -(-size // term_bytes))
    texts = id_and_text(docs, id_col, text_col)
    found = []
    for turn in range(passes):
        part = asked.where(F.pmod(F.xxhash64("uid"), F.lit(passes)) == turn).orderBy("uid").select("item_id", "terms").toArrow()
        if part.num_rows:
            found.append(_round(spark, texts, part, k, owners, bundle_items))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
