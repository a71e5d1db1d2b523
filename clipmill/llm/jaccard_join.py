"""N-gram Jaccard join: rare-first prefix filter with length, positional and suffix filters, one exact check per pair.

Two documents link when |A ∩ B| * 100 >= 90 * |A ∪ B| for their sets of word shingles (``Rule`` holds the numbers).

1. **Rarity.** Every task counts the shingles of its documents in a fixed table of 2^22 counters; the sums give each
   shingle a rarity class. The order is (class, hash): any total order gives the same links, a rarer-first one fewer candidates.
2. **Prefixes.** Of a set of n, only its ``n - ceil(0.9 n) + 1`` rarest shingles are posted: two sets that link share one.
   Documents with equal sets (64-bit digest) are one class and posted once per task, merged per shingle.
   A posting stays only if some partner in its list passes the length and positional filters (a semi join: it stops at the first).
3. **First links.** In the list of a shingle, within a length band, each class looks only at the first one (the most
   central: fewest rarer shingles) and the one before it, and keeps its best partner. Checked exactly, these join most near copies.
4. **The rest.** A list whose classes are still in several components pairs those outside its largest component with
   all others of another component. Length and positional filters stand in the join, a suffix filter (counts by hash range bound the
   symmetric difference) before the sets are fetched. Each pair is checked once. Pairs inside one component
   need no check, so a group of thousands of near copies costs links, not all its pairs; no link between components is lost.
5. **Components** of all links give the smallest reachable id; those of the first links are stars when the others are added.

Sets are made again from the texts of candidate classes only (a fixed-size Bloom filter spares the rest, an exact join follows).
Null, empty and blank texts have no set and link with nothing. Texts with fewer words than a shingle are one shingle. Repeated rows
are copies like others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmill.llm.chunks import combined, packed, whole
from clipmill.llm.components import components
from clipmill.llm.tables import bucketed, small_batches
from clipmill.llm.words import mix, pieces, shingles, words
from clipmill.session import stored

#: Counters of the rarity table and bits of the candidate filter: fixed sizes (4 MB each when sent to tasks).
COUNTERS, FILTER_BITS = 1 << 22, 1 << 25
#: Hash ranges of the suffix filter.
RANGES = 32


@dataclass(frozen=True)
class Rule:
    """Link when ``den`` * intersection >= ``num`` * union of shingles of ``size`` words."""

    size: int = 3
    num: int = 90
    den: int = 100

    def prefix(self, n):
        """How many of the rarest shingles of a set of n have to be posted."""
        return n - (self.num * n + self.den - 1) // self.den + 1


def sets_of(column, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingle hashes of each text, with the text each belongs to, ordered by text and hash."""
    w = words(column, lower=True)
    n_docs = len(w.counts)
    h = w.hashes()
    out, ok = shingles(h, w.first, size)
    doc = w.doc.astype(np.uint32)
    values, owner = out[ok], doc[ok]
    few = np.flatnonzero((w.counts > 0) & (w.counts < size))  # the whole sequence is one shingle
    if len(few):
        extra = mix(w.counts[few].astype(np.uint64))
        for k in range(size - 1):
            has = w.counts[few] > k
            extra[has] = mix(extra[has] * np.uint64(0x9E3779B97F4A7C15) + h[w.first[few[has]] + k])
        values, owner = np.concatenate([values, extra]), np.concatenate([owner, few.astype(np.uint32)])
    return (*distinct(values, owner), n_docs)


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by owner and value, each pair once."""
    order = by_owner(values, owner)
    v, o = values[order], owner[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[first], o[first]


def by_owner(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The order by owner (below 65536 in a piece of a batch) and value; sixteen bits are sorted by radix."""
    order = np.argsort(values)
    return order[np.argsort(owner[order].astype(np.uint16), kind="stable")]


def digests(values: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and 64-bit digest of each text's set; equal sets have equal digests."""
    n = np.bincount(owner, minlength=n_docs)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values), dtype=np.uint64)])
    end = np.cumsum(n)
    return n, mix((total[end] - total[end - n]) ^ mix(n.astype(np.uint64))).view(np.int64)


def _text_pieces(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 10_000):
            yield from pieces(batch.slice(at, 10_000), "text", 1 << 20)


def _profile(docs: DataFrame, rule: Rule) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, cls) of every document, and the rarity class of every counter."""
    kind = dict(docs.dtypes)["doc_id"]
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(id_type)
        total = np.zeros(COUNTERS, np.uint32)
        for part in _text_pieces(batches):
            v, o, size = sets_of(part.column(1), rule.size)
            np.add.at(total, (v & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
            n, cls = digests(v, o, size)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n.astype(np.int32)), pa.array(cls), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
                names=["doc_id", "n", "cls", "chunk", "held"])
        for k, data in packed(total):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, arrow), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([data], pa.binary())],
                names=["doc_id", "n", "cls", "chunk", "held"])

    both = stored(docs.mapInArrow(run, f"doc_id {kind}, n int, cls long, chunk int, held binary"), "join-profile")
    rarity = lambda c: np.minimum(np.rint(8 * np.log2(np.maximum(c, 1).astype(np.float64))), 255).astype(np.uint8)
    found = combined(both.filter("chunk is not null").select("chunk", "held"), "<u4", "add", rarity)
    return both.filter("chunk is null").select("doc_id", "n", "cls"), whole(found, COUNTERS, "u1")


def _postings(docs: DataFrame, rarity, rule: Rule) -> DataFrame:
    """(token, cls, n, pos): the rarest shingles of each class of equal sets; ``pos`` is the place in rarest-first order."""

    def run(batches):
        table, seen = rarity.value, set()
        for part in _text_pieces(batches):
            v, o, size = sets_of(part.column(0), rule.size)
            n, cls = digests(v, o, size)
            rank = (table[(v & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (v >> np.uint64(8))
            order = by_owner(rank, o)
            token, owner = rank[order], o[order]
            pos = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            new = np.zeros(size, bool)
            for d, c in enumerate(cls.tolist()):
                if c not in seen:
                    seen.add(c)
                    new[d] = True
            at = np.flatnonzero(new[owner] & (pos < rule.prefix(n)[owner]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[at].view(np.int64)), pa.array(cls[owner[at]]), pa.array(n[owner[at]].astype(np.int32)), pa.array(pos[at].astype(np.int32))],
                names=["token", "cls", "n", "pos"])

    return docs.select("text").mapInArrow(run, "token long, cls long, n int, pos int")


def _band(n, rule: Rule):
    """Lengths of linked sets lie in the same band or in adjacent ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(rule.den / rule.num)) + F.lit(1e-9)).cast("int")


def _may_link(na, pa_, nb, pb, rule: Rule):
    """Length filter, and positional filter for the first shared shingle."""
    least, most = F.least(na, nb), F.greatest(na, nb)
    need = F.ceil(F.lit(rule.num) * (na + nb) / F.lit(rule.num + rule.den))
    return (rule.den * least >= rule.num * most) & (F.least(na - pa_, nb - pb) >= need)


def _candidate_sets(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(cls, n, ranges, held) of the classes given: counts by hash range, and the sorted hashes as bytes."""
    bits = FILTER_BITS

    def mark(batches):
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            c = batch.column(0).to_numpy().view(np.uint64)
            for at in (c & np.uint64(bits - 1), (c >> np.uint64(32)) & np.uint64(bits - 1)):
                np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        rows = list(packed(table))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["chunk", "held"])

    table = whole(combined(classes.select("cls").mapInArrow(mark, "chunk int, held binary"), "u1", "bitwise_or"), bits // 8, "u1")
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table, seen = sent.value, set()
        for part in _text_pieces(batches):
            v, o, size = sets_of(part.column(0), rule.size)
            n, cls = digests(v, o, size)
            c = cls.view(np.uint64)
            hit = n > 0
            for at in (c & np.uint64(bits - 1), (c >> np.uint64(32)) & np.uint64(bits - 1)):
                hit &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            end = np.cumsum(n)
            rows = [d for d in np.flatnonzero(hit).tolist() if not (cls[d] in seen or seen.add(cls[d]))]
            counts = [np.bincount((v[end[d] - n[d]:end[d]] >> np.uint64(59)).astype(np.int64), minlength=RANGES).astype(np.int32) for d in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array(cls[rows], pa.int64()), pa.array(n[rows].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * RANGES, pa.int32()), pa.array(np.concatenate(counts) if rows else np.zeros(0, np.int32))),
                pa.array([v[end[d] - n[d]:end[d]].tobytes() for d in rows], pa.binary())], names=["cls", "n", "ranges", "held"])

    made = docs.select("text").mapInArrow(run, "cls long, n int, ranges array<int>, held binary")
    return bucketed(made.join(classes, "cls", "left_semi").dropDuplicates(["cls"]), "cls", "join_sets")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link: suffix filter on the counts by range, then the exact intersection."""
    brief = lambda c: sets.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("ranges").alias(f"r{c}"))
    apart = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    need = F.ceil(F.lit(rule.num) * (F.col("na") + F.col("nb")) / F.lit(rule.num + rule.den))
    near = pairs.join(brief("a"), "a").join(brief("b"), "b").filter(apart <= F.col("na") + F.col("nb") - 2 * need).select("a", "b")
    held = lambda c: sets.select(F.col("cls").alias(c), F.col("held").alias(f"h{c}"))
    num, den = rule.num, rule.den

    def run(batches):
        for batch in batches:
            a, b, ha, hb = batch.columns
            good = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(ha[i].as_buffer(), "<u8"), np.frombuffer(hb[i].as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                good.append(den * common >= num * (len(x) + len(y) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    full = near.join(held("a"), "a").join(held("b"), "b").select("a", "b", "ha", "hb")
    return stored(full.mapInArrow(run, "a long, b long"), "join-links")


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def class_links(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, cls) of all documents, (a, b) links that connect all linked classes, and (node, comp)."""
    profile, classes = _profile(docs, rule)
    rarity = docs.sparkSession.sparkContext.broadcast(classes)
    posted = _postings(docs, rarity, rule).repartition("token").distinct().withColumn("band", _band("n", rule))
    line = Window.partitionBy("token").orderBy("cls")
    lists = posted.withColumn("l", F.lag("cls").over(line)).withColumn("r", F.lead("cls").over(line))
    lists = stored(lists.filter("l is not null or r is not null").drop("l", "r"), "join-lists")
    # postings with a partner in their list that the length and positional filters let through
    around = lists.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), *[F.col(c).alias(f"{c}_x") for c in ("cls", "n", "pos")])
    fits = (lists.token == around.token) & (lists.band == around.band) & (F.col("cls") != F.col("cls_x")) & _may_link(F.col("n"), F.col("pos"), F.col("n_x"), F.col("pos_x"), rule)
    useful = lists.join(around, fits, "left_semi")
    near = Window.partitionBy("token", "band").orderBy("pos", "n", "cls")
    multi = useful.withColumn("prev", F.lag("cls").over(near)).withColumn("lead", F.first("cls").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    multi = stored(multi, "join-useful")

    sets = _candidate_sets(docs, stored(multi.select("cls").distinct(), "join-classes"), rule)
    tries = multi.select("cls", F.explode(F.array_distinct(F.array("prev", "lead"))).alias("other")).filter("other is not null and other <> cls")
    best = tries.groupBy("cls", "other").agg(F.count(F.lit(1)).alias("shared")).groupBy("cls").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))
    first = _verified(best.select(*_pair("cls", "other")).distinct(), sets, rule)
    comps = stored(components(first), "join-comps")

    placed = multi.select("token", "cls", "n", "pos", "band").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    placed = stored(placed, "join-placed")
    sizes = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("token", "main")
    mixed = stored(placed.join(mixed, "token"), "join-mixed")
    left = mixed.filter("comp <> main").select("token", *[F.col(c).alias(f"{c}_x") for c in ("cls", "n", "pos", "comp")], F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    fits = (F.col("comp") != F.col("comp_x")) & _may_link(F.col("n"), F.col("pos"), F.col("n_x"), F.col("pos_x"), rule)
    rest = left.join(mixed, ["token", "band"]).filter(fits).select(*_pair("cls", "cls_x")).distinct()
    second = _verified(rest, sets, rule)
    joined = components(second.union(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
    return profile, first.union(second), joined


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (to other sets, as found while connecting)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        profile, links, comps = class_links(rows, rule)
    ids = profile.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    joined = ids.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = joined.groupBy("comp").agg(F.min("least").alias("component_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    named = joined.join(least, "comp").join(degree, "cls", "left").select("cls", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return (
        profile.join(named, "cls", "left")
        .select("doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; columns stay as they are.

    Of rows that repeat id and text one stays; rows that share only the id stay or go together.
    """
    first = jaccard_components(docs, id_col, text_col, rule).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chosen = first.select(key("doc_id").alias("__id")).distinct()
    keyed = docs.withColumn("__id", key(id_col)).withColumn("__sha", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    joined = keyed.join(chosen, "__id", "left_semi")
    once = F.row_number().over(Window.partitionBy("__id", "__sha").orderBy("__sha"))
    return joined.withColumn("__n", once).filter("__n = 1").select(docs.columns)
