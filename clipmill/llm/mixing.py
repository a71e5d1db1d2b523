"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every document may be taken up to three times. Within a source the copies stand in a shuffled order (md5 of seed
and id, so reruns agree); a copy's virtual finish time is the source's tokens up to and with it, divided by the
source's target. All copies are range-sorted by finish time and the mix ends where its tokens reach the budget.

* The running sum of a source is a sum over hash buckets plus one inside a bucket, so a source that holds a third
  of all rows spreads over many tasks.
* The sorted copies are a table in the shared folder; tokens are summed per written part, and only the part in
  which the budget ends is looked at row by row. Its last row becomes one scalar that every document is held against.

Null and empty texts have size 0 and are never taken; a null source is a source of its own, last in order; repeated
rows are documents of their own; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmill.session import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source that are summed in order together, and (as a power of two) rows of the sorted mix that are summed as one block.
BUCKET_ROWS, BLOCK_ROWS = 1_000, 10


def source_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """(source, source_size, n_rows, weight): weights 1..cycle repeat over sources in code-point order, null last.

    Sources are range-sorted and numbered by part totals, so their number may be large.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ordered = stored(totals.orderBy(F.col("source").isNull(), "source").withColumn("place", F.monotonically_increasing_id()), "mix-sources")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return (
        ordered.withColumn("part", part).join(before, "part")
        .withColumn("weight", (F.col("before") + row) % cycle + 1)
        .select("source", "source_size", "n_rows", "weight")
    )


def water_level(sources: DataFrame, budget: int, most: int) -> float:
    """The level λ with Σ min(λ·weight, most·size) = budget; each round settles every source below the level."""
    level = -1.0
    while True:
        settled = F.col("weight") * F.lit(level) > most * F.col("source_size")
        row = sources.agg(
            F.coalesce(F.sum(F.when(settled, most * F.col("source_size"))), F.lit(0)).alias("done"),
            F.coalesce(F.sum(F.when(~settled, F.col("weight"))), F.lit(0)).alias("weights")).first()
        new = (budget - row.done) / row.weights if row.weights else level
        if new <= level:
            return max(level, 0.0)
        level = new


def _cut(mixed: DataFrame, budget: int, rank: tuple[str, ...]):
    """The first row of the sorted mix that would exceed the budget; None if all fits. Looks at parts, then blocks of the part, then rows of the block."""
    before, rows = 0, mixed
    for shift in (33, BLOCK_ROWS):
        held = rows.groupBy(F.shiftright("place", shift).alias("piece")).agg(F.sum("size").alias("held"))
        upto = F.sum("held").over(Window.orderBy("piece")) + before
        edge = held.select("piece", upto.alias("upto"), "held").filter(F.col("upto") > budget).orderBy("piece").first()
        if edge is None:
            return None
        before, rows = edge.upto - edge.held, rows.filter(F.shiftright("place", shift) == edge.piece)
    run = F.sum("size").over(Window.orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0)) + before
    return rows.withColumn("run", run).filter(F.col("run") > budget).orderBy(*rank).first()


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        most: int = 3, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken, source, weight, copies."""
    sized = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")), "mix-sizes")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sources = stored(source_weights(sized), "mix-weights")
    budget = int(total * share)
    level = water_level(sources, budget, most)
    targets = sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), (most * F.col("source_size")).cast("double")))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = (
        sized.join(targets, sized.source.eqNullSafe(targets.source)).drop(targets.source)
        .withColumn("key", order)
        .withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BUCKET_ROWS)))
        .withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * F.col("buckets") / F.lit(1 << 32)))
    )
    within = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    before = within.select(
        F.col("source").alias("of"), F.col("bucket").alias("at"),
        (F.sum("held").over(Window.partitionBy("source").orderBy("bucket")) - F.col("held")).alias("before"))
    line = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        rows.join(before, rows.source.eqNullSafe(before.of) & (rows.bucket == before["at"]))
        .withColumn("upto", F.col("before") + F.sum("size").over(line))
        .withColumn("n", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")))
        .select("doc_id", "source", "size", "source_size", "weight", "target", "key", "upto", "n")
    )
    queued = stored(queued, "mix-queue")
    finish = lambda copy: F.try_divide(F.col("upto") + copy * F.col("source_size"), F.col("target"))
    copies = (
        queued.filter("size > 0 and target > 0").withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(most)])))
        .select(finish(F.col("copy")).alias("finish"), "key", "doc_id", "n", "copy", "size")
    )
    rank = ("finish", "key", "doc_id", "n", "copy")
    # written in sort order: ``place`` holds the part and the row in it
    mixed = stored(copies.orderBy(*rank).withColumn("place", F.monotonically_increasing_id()), "mix-sorted")
    cut = _cut(mixed, budget, rank)
    flags = []
    for k in range(most):
        t = finish(F.lit(k))
        if cut is not None:
            here = F.struct(t.alias("a"), F.col("key").alias("b"), F.col("doc_id").alias("c"), F.col("n").alias("d"), F.lit(k).alias("e"))
            last = F.struct(F.lit(cut.finish).alias("a"), F.lit(cut.key).alias("b"), F.lit(cut.doc_id).cast(dict(queued.dtypes)["doc_id"]).alias("c"), F.lit(cut.n).alias("d"), F.lit(cut.copy).alias("e"))
            taken = here < last
        else:
            taken = F.lit(True)
        flags.append(F.when(F.col("target").isNotNull() & (F.col("target") > 0) & (F.col("size") > 0) & taken, 1).otherwise(0))
    taken = flags[0]
    for f in flags[1:]:
        taken = taken + f
    return (
        queued.withColumn("copies", taken.cast("bigint"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "weight", "copies")
    )


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns stay as they are. Rows are told apart by id and text."""
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    keyed = docs.withColumn("__row", key)
    mixed = mix(keyed, "__row", text_col, source_col, **params).filter("copies > 0")
    times = mixed.groupBy(F.col("doc_id").alias("__row")).agg(F.max("copies").alias("__copies"))
    joined = keyed.join(times, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
    return joined.select(docs.columns)
