"""Near-duplicate groups by min-max hashing: every permutation gives a minimum and a maximum, and both go into the signature.

Two documents link when |A ∩ B| * 100 >= 85 * |A ∪ B| for their sets of word shingles (``Rule`` holds the numbers). A minimum agrees with
the probability of the similarity, and so does a maximum, so 60 permutations give 120 values; minima and maxima stand in bands of
their own, so the values of a band are of different permutations.

1. One pass over the texts gives each document its set size and class (128-bit digest of the set; equal sets are one class), and each
   class of a task its band keys. Classes get numbers; copies travel once per task.
2. Classes that share a band key form a list. 30 bands of 4 values miss a pair at the threshold with a probability below 1e-9.
3. In each list a class first looks only at the most central one (with most company in all its lists) and at its neighbour; the best
   partner of each class is checked on the full sets. These links join most groups, whatever their size.
4. In lists that still hold several components, every class outside the largest is paired with all of other components. Pairs inside one
   component need no check, so a group of thousands costs links, not all its pairs, and no link between components is lost.
5. A list that would give more than ``long_list`` pairs (sets that share a passage, copies just below the threshold beside many others) is
   paired by rare shingles instead, the partners with most in common first: sets that link share one of their ``n - ceil(0.85 n) + 1`` rarest, at places that leave
   enough to share. Copies with changes of their own have rare shingles of their own, so most meet nobody; no link is lost.
6. Links are confirmed on full sets of 64-bit shingle hashes (lengths, then counts by hash range, then the intersection); components of
   links give the smallest reachable id.

Null, empty and blank texts have no set and link with nothing. Texts with fewer words than a shingle are one shingle. Repeated rows are
copies like others; a null id comes after all others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmill.llm.chunks import combined, packed, whole
from clipmill.llm.jaccard_join import RANGES, sets_of
from clipmill.llm.tables import small_batches
from clipmill.llm.words import mix, pieces
from clipmill.session import stored

#: Bits of the filter that spares the sets of documents without candidates (4 MB when sent), counters of rare shingles (16 MB when sent), and
#: bytes of text worked on at once.
FILTER_BITS, COUNTERS, PIECE = 1 << 25, 1 << 22, 1 << 20


@dataclass(frozen=True)
class Rule:
    """Link when ``den`` * intersection >= ``num`` * union of shingles of ``size`` words; bands, values of a band, pairs of a list that is long, and first partners in such lists."""

    size: int = 5
    num: int = 85
    den: int = 100
    bands: int = 30
    values: int = 4
    long_list: int = 256
    tries: int = 8


@lru_cache(maxsize=8)
def multipliers(count: int) -> np.ndarray:
    """Odd 64-bit numbers; multiplying by one permutes 64-bit hashes."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def min_max(values: np.ndarray, starts: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of every set under ``count`` permutations, each of shape (sets, count); sets begin at ``starts``."""
    low, high = np.empty((len(starts), count), np.uint64), np.empty((len(starts), count), np.uint64)
    for k, a in enumerate(multipliers(count)):
        h = values * a
        low[:, k], high[:, k] = np.minimum.reduceat(h, starts), np.maximum.reduceat(h, starts)
    return low, high


def band_keys(values: np.ndarray, starts: np.ndarray, bands: int, size: int) -> np.ndarray:
    """One 64-bit key for each set and band: the first half of the bands from minima, the rest from maxima."""
    each = (bands + 1) // 2
    sides = min_max(values, starts, each * size)
    keys = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        side, at = sides[b // each], (b % each) * size
        key = np.full(len(starts), mix(np.array([b + 1], np.uint64))[0])
        for k in range(size):
            key = mix(key * np.uint64(3) + side[:, at + k])
        keys[:, b] = key
    return keys.view(np.int64)


def classes_of(values: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and 128-bit digest (two columns) of each text's set; equal sets have equal digests."""
    n = np.bincount(owner, minlength=n_docs)
    end = np.cumsum(n)
    out = np.empty((n_docs, 2), np.uint64)
    for c, salt in enumerate((0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)])
        out[:, c] = mix((total[end] - total[end - n]) ^ mix(n.astype(np.uint64)))
    return n, out


def _binary(digests: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(digests).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer(np.arange(len(digests) + 1, dtype=np.int32) * 16), pa.py_buffer(data)])


def _text_pieces(batches, column: int):
    for batch in batches:
        for at in range(0, batch.num_rows, 10_000):
            yield from pieces(batch.slice(at, 10_000), batch.schema.names[column], PIECE)


def _fresh(digests: np.ndarray, usable: np.ndarray, seen: set) -> np.ndarray:
    """Texts whose class the task has not met before."""
    out = []
    for d in np.flatnonzero(usable).tolist():
        c = digests[d].tobytes()
        if c not in seen:
            seen.add(c)
            out.append(d)
    return np.array(out, np.int64)


def _lists(rows: int, array: np.ndarray) -> pa.Array:
    width = array.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(array.ravel()))


def profile(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, cls, keys) of every document; ``keys`` is null where the task has given the class's keys before."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        seen: set = set()
        for part in _text_pieces(batches, 1):
            v, o, size = sets_of(part.column(1), rule.size)
            n, cls = classes_of(v, o, size)
            new = _fresh(cls, n > 0, seen)
            keys = np.zeros((0, rule.bands), np.int64)
            if len(new):
                held = np.zeros(size, bool)
                held[new] = True
                keys = band_keys(v[held[o]], np.concatenate([[0], np.cumsum(n[new])[:-1]]), rule.bands, rule.values)
            at = np.full(size, -1)
            at[new] = np.arange(len(new))
            column = _lists(len(new), keys).take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32)), _binary(cls), column], names=["doc_id", "n", "cls", "keys"])

    return stored(docs.mapInArrow(run, f"doc_id {kind}, n int, cls binary, keys array<long>"), "minmax-profile")


def _marked(classes: DataFrame) -> np.ndarray:
    """A filter of fixed size over the digests of ``classes`` (cls)."""

    def mark(batches):
        table = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for at in _places(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8").reshape(-1, 2)):
                np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        rows = list(packed(table))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["chunk", "held"])

    return whole(combined(classes.select("cls").mapInArrow(mark, "chunk int, held binary"), "u1", "bitwise_or"), FILTER_BITS // 8, "u1")


def _places(digests: np.ndarray):
    return digests[:, 0] & np.uint64(FILTER_BITS - 1), digests[:, 1] & np.uint64(FILTER_BITS - 1)


def sets_for(docs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(id, n, ranges, held) of the classes given (id, cls): counts by hash range, and the sorted hashes as bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(_marked(classes))

    def run(batches):
        table, seen = sent.value, set()
        for part in _text_pieces(batches, 0):
            v, o, size = sets_of(part.column(0), rule.size)
            n, cls = classes_of(v, o, size)
            hit = n > 0
            for at in _places(cls):
                hit &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            new = _fresh(cls, hit, seen)
            end = np.cumsum(n)
            held = [v[end[d] - n[d]:end[d]] for d in new.tolist()]
            counts = [np.bincount((h >> np.uint64(59)).astype(np.int64), minlength=RANGES).astype(np.int32) for h in held]
            yield pa.RecordBatch.from_arrays(
                [_binary(cls[new]), pa.array(n[new].astype(np.int32)), _lists(len(new), np.array(counts, np.int32).reshape(len(new), RANGES)), pa.array([h.tobytes() for h in held], pa.binary())],
                names=["cls", "n", "ranges", "held"])

    made = docs.select("text").mapInArrow(run, "cls binary, n int, ranges array<int>, held binary")
    once = made.join(classes.select("cls", "id"), "cls").dropDuplicates(["id"]).drop("cls")
    return stored(once, "minmax-sets")


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def near_in_length(na, nb, rule: Rule):
    return rule.den * F.least(na, nb) >= rule.num * F.greatest(na, nb)


def confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The distinct pairs (a, b) that link."""
    need = F.ceil(F.lit(rule.num) * (F.col("na") + F.col("nb")) / F.lit(rule.num + rule.den))
    apart = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    brief = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("ranges").alias(f"r{c}"))
    maybe = pairs.join(brief("a"), "a").join(brief("b"), "b").filter(near_in_length(F.col("na"), F.col("nb"), rule) & (apart <= F.col("na") + F.col("nb") - 2 * need)).select("a", "b")
    held = lambda c: sets.select(F.col("id").alias(c), F.col("held").alias(f"h{c}"))
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

    full = maybe.join(held("a"), "a").join(held("b"), "b").select("a", "b", "ha", "hb")
    return stored(full.mapInArrow(run, "a long, b long"), "minmax-links")


def shared_lists(posted: DataFrame) -> DataFrame:
    """Rows of ``posted`` (key, id, n, ...) whose key has at least two classes, with ``company``, the number of others."""
    size = F.count(F.lit(1)).over(Window.partitionBy("key"))
    return stored(posted.withColumn("company", size - 1).filter("company > 0"), "minmax-lists")


def first_pairs(lists: DataFrame, most: int = 1) -> DataFrame:
    """For every class the ``most`` partners it shares most lists with, among each list's most central class and the class's neighbours."""
    central = lists.groupBy("id").agg(F.sum("company").alias("central"))
    line = Window.partitionBy("key").orderBy(F.col("central").desc(), "id")
    ranked = lists.join(central, "id").withColumn("t0", F.first("id").over(line))
    for k in range(1, most + 1):
        ranked = ranked.withColumn(f"t{k}", F.lag("id", k).over(line))
    tried = ranked.select("id", F.explode(F.array_distinct(F.array(*[f"t{k}" for k in range(most + 1)]))).alias("other")).filter("other is not null and other <> id")
    shared = tried.groupBy("id", "other").agg(F.count(F.lit(1)).alias("shared"))
    if most == 1:
        best = shared.groupBy("id").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))
    else:
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("shared").desc(), F.col("other").desc()))
        best = shared.withColumn("rk", rank).filter(F.col("rk") <= most)
    return best.select(*_pair("id", "other")).distinct()


def mixed_lists(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Lists that hold several components: the lists' columns, comp, main, pairs: classes outside the main component times all."""
    placed = lists.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    facts = sizes.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), ((F.sum("k") - F.max("k")) * F.sum("k")).alias("pairs")).filter("pairs > 0")
    return stored(placed.join(facts, "key"), "minmax-mixed")


def cross_pairs(mixed: DataFrame, rule: Rule) -> DataFrame:
    """All pairs of different components that a list holds and whose lengths (and places, if known) allow a link; each pair once."""
    columns = [c for c in ("id", "n", "comp", "pos") if c in mixed.columns]
    left = mixed.filter("comp <> main").select("key", *[F.col(c).alias(f"{c}_x") for c in columns])
    once = (F.col("comp") == F.col("main")) | (F.col("id_x") < F.col("id"))
    fits = (F.col("comp") != F.col("comp_x")) & once & near_in_length(F.col("n"), F.col("n_x"), rule)
    if "pos" in columns:
        need = F.ceil(F.lit(rule.num) * (F.col("n") + F.col("n_x")) / F.lit(rule.num + rule.den))
        fits &= F.least(F.col("n") - F.col("pos"), F.col("n_x") - F.col("pos_x")) >= need
    return left.join(mixed, "key").filter(fits).select(*_pair("id", "id_x")).distinct()


def rare_lists(sets: DataFrame, rule: Rule) -> DataFrame:
    """(key, id, n, pos): the rarest shingles of each set, with their place in rarest-first order; rarity is counted within ``sets``.

    Counts stand in a table of fixed size, so shingles may share a counter: the order decides how many pairs there are, not which links.
    """

    def count(batches):
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for held in batch.column(0):
                np.add.at(total, (np.frombuffer(held.as_buffer(), "<u8") & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
        rows = list(packed(total))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["chunk", "held"])

    counts = whole(combined(sets.select("held").mapInArrow(count, "chunk int, held binary"), "<u4", "add"), COUNTERS, "<u4")
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            ids, sizes, tokens = batch.column(0), [], []
            for held in batch.column(2):
                v = np.frombuffer(held.as_buffer(), "<u8")
                often = sent.value[(v & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((v, often))[:len(v) - (rule.num * len(v) + rule.den - 1) // rule.den + 1]
                tokens.append(v[order])
                sizes.append(len(order))
            each = np.array(sizes, np.int64)
            row = np.repeat(np.arange(len(each)), each)
            place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            key = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), ids.take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(place.astype(np.int32))], names=["key", "id", "n", "pos"])

    return sets.select("id", "n", "held").mapInArrow(run, "key long, id long, n int, pos int")


def stars(links: DataFrame) -> DataFrame:
    """(node, comp) of every node that has a link, ``comp`` being its component's smallest node; ends when all links are stars.

    A round hangs the larger neighbours of a node, then the smaller ones, on its smallest neighbour. It was the last if no node has two
    links upwards or one upwards and one downwards; links of classes with a central one need a single round.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "minmax-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "minmax-stars")
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up > 1 or up = 1 and down = 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def joined_up(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` after more links between classes of different components."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above = stored(stars(between), "minmax-comps")
    moved = comps.join(above.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    fresh = above.join(comps.select("node"), "node", "left_anti")
    return stored(moved.union(fresh), "minmax-comps")


def class_components(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, cls) of all documents, (id, cls) of all classes, (node, comp) of the classes that link."""
    rows = profile(docs, rule)
    once = rows.filter("keys is not null").dropDuplicates(["cls"])
    classes = stored(once.select(F.monotonically_increasing_id().alias("id"), "cls", "n", "keys"), "minmax-classes")
    lists = shared_lists(classes.select("id", "n", F.explode("keys").alias("key")))
    busy = classes.select("id", "cls").join(lists.select("id").distinct(), "id", "left_semi")
    sets = sets_for(docs, busy, rule)
    comps = stored(stars(confirmed(first_pairs(lists), sets, rule)), "minmax-comps")
    mixed = mixed_lists(lists, comps)
    more = confirmed(cross_pairs(mixed.filter(F.col("pairs") <= rule.long_list), rule), sets, rule)
    if not more.isEmpty():
        comps = joined_up(comps, more)
    crowded = mixed.filter(F.col("pairs") > rule.long_list)
    if not crowded.isEmpty():
        some = stored(sets.join(crowded.select("id").distinct(), "id", "left_semi"), "minmax-crowded")
        rare = shared_lists(rare_lists(some, rule))
        comps = joined_up(comps, confirmed(first_pairs(rare, rule.tries), some, rule))
        more = confirmed(cross_pairs(mixed_lists(rare, comps), rule), some, rule)
        if not more.isEmpty():
            comps = joined_up(comps, more)
    return rows.select("doc_id", "n", "cls"), classes.select("id", "cls"), comps


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        rows, classes, comps = class_components(texts, rule)
    least = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least")).join(classes, "cls")
    joined = least.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    named = joined.join(joined.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("cls", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(named, "cls", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
