"""Quality rules: word and line rules, and bands of perplexity under a character model counted by Spark.

The model is an interpolated modified Kneser-Ney model of four characters over all texts, by code points and with all its n-grams
(``characters.py``). It is never whole in one place: its counts, contexts and probabilities are tables, and a block of documents is
sent the values of the n-grams it holds. An occurrence does not count for itself. The perplexity is that of a character.

The bands of a language are its own median log perplexity and so many robust deviations (1.4826 times the median absolute
deviation) above and below. Few documents only widen them: the deviation is raised towards that within all languages, and the
standard error of the median is added. A document outside is rejected; the only one of its language lies at its median.

Null and empty texts have no words and fail the word rule; a null language is a language of its own. Repeated rows are judged each
for itself. An empty table gives no rows. Columns of any name pass through ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipmill.llm import characters
from clipmill.llm.folded import BITS, REGIONS, WIDE, Model, grams, train, wide_regions, wide_slots  # noqa: F401  the model of fixed size
from clipmill.llm.tables import small_batches
from clipmill.llm.words import BLANK, buffers, mix, per_text, pieces, shingles, span_hashes, words
from clipmill.session import stored

#: Robust deviations above and below the median that a clean document may lie; documents that outweigh the deviation within all languages.
UPPER, LOWER_BAND, PULL = 5.0, 5.0, 50
#: Bytes of text that are worked on at once, and the grid on which medians are counted.
PIECE, GRID = 1 << 19, 100_000
#: No deviation counts as smaller than this (in nats a character), so that uniform corpora keep their ordinary documents.
LEAST_SPREAD = 0.01
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: Bytes of text of a block of documents, whose n-grams are looked up together.
BLOCK = 1 << 23

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeats(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which entries have a value that occurs twice or more within their owner."""
    key = mix(h + mix(owner.astype(np.uint64)))
    line = np.sort(key)
    twice = np.unique(line[1:][line[1:] == line[:-1]])
    if not len(twice):
        return np.zeros(len(h), bool)
    seen = np.zeros(1 << 20, bool)
    seen[(twice & np.uint64(0xFFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(key & np.uint64(0xFFFFF)).astype(np.int64)])
    out = np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(twice, key[maybe]), len(twice) - 1)
    out[maybe] = twice[at] == key[maybe]
    return out


def rule_counts(column) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = words(column)
    n = len(w.counts)
    data, off = w.data, w.offsets
    ink = ~BLANK[data]
    out = {
        "n_words": w.counts, "word_chars": per_text(ink & ((data & 0xC0) != 0x80), off),
        "n_symbols": per_text(SYMBOL[data], off),
    }
    # lines: cut at every line break and at the ends of texts
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, off[1:]]))
    inked = np.concatenate([[0], np.cumsum(ink, dtype=np.int64)])
    full = inked[ends] > inked[starts]
    starts, ends = starts[full], ends[full]
    owner = np.searchsorted(off, starts, "right") - 1
    h = span_hashes(data, starts, ends)
    same = np.flatnonzero(_repeats(h, owner))
    first = pd.DataFrame({"o": owner[same], "h": h[same]}).duplicated()
    out["n_dup_lines"] = np.bincount(owner[same][first.to_numpy()], minlength=n)
    three, whole = shingles(w.hashes(), w.first, 3)
    doc, at = w.doc, np.flatnonzero(whole)
    twice = at[_repeats(three[at], doc[at])]
    covered = np.zeros(len(three), bool)
    for k in range(3):
        covered[twice + k] = True
    out["n_repeat_words"] = per_text(covered, w.first)
    return out


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def ruled(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with columns c0, c1, ... for its own, the counts of ``RULES``, and ``block``: rows of a task with about ``BLOCK`` bytes of text, one after the other."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    text = inner[docs.columns.index(text_col)]

    def run(batches):
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in pieces(batch, text, PIECE):
                column = part.column(part.schema.get_field_index(text))
                found = rule_counts(column)
                size = len(buffers(column)[0])
                if held and held + size > BLOCK:
                    block, held = block + 1, 0
                held += size
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(found[k], pa.int64()) for k in RULES), pa.array(np.full(len(column), block, np.int64))],
                    names=[*inner, *RULES, "block"])

    plain = docs.toDF(*inner)
    schema = ", ".join([*(f"{c} {t}" for c, t in plain.dtypes), *(f"{k} long" for k in RULES), "block long"])
    return stored(plain.mapInArrow(run, schema), "quality-rules", "zstd")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of ``RULES`` and the log perplexity of a character behind its own columns, each prefixed by ``__``."""
    rows = ruled(docs, text_col)
    text = rows.columns[docs.columns.index(text_col)]
    grams_of = characters.block_grams(rows, "block", text, PIECE)
    model = characters.kneser_ney(grams_of.groupBy("a", "b").agg(F.sum("n").alias("n")))
    scored = characters.score(rows, "block", text, characters.block_values(grams_of, model), PIECE)
    return scored.drop("block").toDF(*docs.columns, *(f"__{k}" for k in (*RULES, "log_ppl")))


def medians(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, middle): the lower median of ``value`` for every key, null being a key.

    Values are counted on a grid of 1 / ``GRID``, so the result does not depend on how rows are dealt out; what is ranked is the
    counted grid, whose size follows the spread of the values, not the rows.
    """
    cells = values.groupBy(key, F.rint(F.col(value) * GRID).cast("bigint").alias("cell")).agg(F.count(F.lit(1)).alias("k"))
    line = Window.partitionBy(key).orderBy("cell")
    ranked = cells.withColumn("upto", F.sum("k").over(line)).withColumn("n", F.sum("k").over(Window.partitionBy(key)))
    middle = F.min(F.when(2 * F.col("upto") >= F.col("n"), F.col("cell")))
    return ranked.groupBy(key).agg(F.first("n").alias("n"), (middle / GRID).alias("middle"))


def bands(measured: DataFrame, lang_col: str = "lang") -> DataFrame:
    """(lang, low, high) of log perplexity for every language among documents that pass the word rule."""
    usable = measured.filter(F.col("__n_words") >= MIN_WORDS).select(F.col(lang_col).cast("string").alias("lang"), F.col("__log_ppl").alias("x"))
    centre = medians(usable, "lang", "x").select(F.col("lang").alias("of"), F.col("middle").alias("mid"))
    off = usable.join(centre, F.col("lang").eqNullSafe(F.col("of"))).select("lang", F.abs(F.col("x") - F.col("mid")).alias("off"))
    spread = medians(off, "lang", "off").join(centre, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "n", "mid", F.col("middle").alias("mad"))
    all_mad = medians(off.withColumn("every", F.lit(True)), "every", "off").first()
    all_mad = all_mad.middle if all_mad else 0.0
    pulled = (F.col("n") * F.col("mad") + PULL * F.lit(all_mad)) / (F.col("n") + PULL)
    dev = F.greatest(1.4826 * F.greatest("mad", pulled), F.lit(LEAST_SPREAD)) * F.sqrt(1 + np.pi / 2 / F.col("n"))
    return spread.select("lang", (F.col("mid") - LOWER_BAND * dev).alias("low"), (F.col("mid") + UPPER * dev).alias("high"))


def base_failed():
    return (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PCT * F.col("__n_words"))


def judge(measured: DataFrame, limits: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Adds ``__base_failed`` and ``__kept``."""
    limits = limits.withColumnRenamed("lang", "__of")
    joined = measured.join(limits.select("__of", F.col("low").alias("__low"), F.col("high").alias("__high")), F.col(lang_col).cast("string").eqNullSafe(F.col("__of")), "left")
    fits = F.col("__log_ppl").between(F.col("__low"), F.col("__high"))
    return joined.withColumn("__base_failed", base_failed()).withColumn("__kept", ~F.col("__base_failed") & F.coalesce(fits, F.lit(True)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, the rule counts, base_failed, kept, log_ppl, low and high of its language."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        measured = stored(measure(rows).drop("text"), "quality")
    judged = judge(measured, stored(bands(measured), "bands"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl", "low", "high")
    return judged.select("doc_id", *[F.col(f"__{k}").alias(k) for k in names])


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules and bands keep, with the columns as they are."""
    with small_batches(docs.sparkSession):
        measured = stored(measure(docs, text_col), "quality", "zstd")
    return judge(measured, stored(bands(measured, lang_col), "bands"), lang_col).filter("__kept").select(docs.columns)
