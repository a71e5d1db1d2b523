"""Dataset unions, chat samples, composed phrases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipmill.functions.arrays import even_indices
from clipmill.functions.text import PROMPT_OUTPUT_CONTRACT, strip
from clipmill.operators.ranking import digits_for, hash_number, hash_row_number
from clipmill.session import local_rows


def union_datasets(parts: Mapping[str, DataFrame], cap: int | None = None) -> DataFrame:
    """Rows of all datasets in order, ids prefixed ``dataset:``; ``cap`` keeps the first rows."""
    tagged = [
        df.withColumn("dataset", F.lit(name)).withColumn("dataset_ord", F.lit(i))
        .withColumn("sample_id", F.concat(F.lit(f"{name}:"), F.col("sample_id")))
        for i, (name, df) in enumerate(parts.items())
    ]
    union = reduce(DataFrame.unionByName, tagged)
    return union if cap is None else union.orderBy("dataset_ord", "index").limit(cap)


def chat_samples(df: DataFrame, dataset: str, max_images: int = 6, prompt: str = PROMPT_OUTPUT_CONTRACT) -> DataFrame:
    """(sample_id, label, frame_paths[]) -> (sample_id, dataset, label, messages[])."""
    paths = F.col("frame_paths")
    picks = even_indices(F.size(paths), max_images, "all")
    text = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"), F.lit(None).cast("string").alias("image"))
    images = F.transform(
        picks, lambda i: F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.get(paths, i.cast("int")).alias("image"))
    )
    none = F.array().cast("array<struct<type:string,text:string,image:string>>")
    user = F.struct(F.lit("user").alias("role"), F.concat(F.array(text(F.lit(prompt))), F.coalesce(images, none)).alias("content"))
    answer = F.struct(F.lit("assistant").alias("role"), F.array(text(F.col("label"))).alias("content"))
    return df.select(
        F.concat(F.lit(f"{dataset}:"), strip(F.col("sample_id"))).alias("sample_id"), F.lit(dataset).alias("dataset"), "label",
        F.array(user, answer).alias("messages"),
    )


def phrase_words(
    phrases: DataFrame, glosses: Sequence[str], min_words: int, max_words: int, repeat_probability: float, seed: int
) -> DataFrame:
    """(phrase, slot, word): the next word repeats the last one or is drawn from the others.

    Every draw is md5 of (seed, purpose, phrase, slot), so a lost task makes the same phrases again.
    The fold runs over at most ``max_words`` slots of one row.
    """
    if not glosses:
        raise ValueError("no labels for phrase sampling")
    if min_words < 1 or max_words < min_words or not 0.0 <= repeat_probability <= 1.0:
        raise ValueError("invalid phrase settings")
    names = F.array(*[F.lit(g) for g in glosses])
    n = len(glosses)
    draw = lambda what, slot: hash_number(F.lit(seed), F.lit(what), F.col("phrase"), slot)
    count = F.lit(min_words) + draw("count", F.lit(0)) % (max_words - min_words + 1)

    def step(acc: Column, slot: Column) -> Column:
        last = F.element_at(acc, -1)
        repeat = draw("repeat", slot) % 1_000_000 < F.lit(round(repeat_probability * 1_000_000))
        other = draw("word", slot) % max(n - 1, 1)
        nxt = F.when(repeat | F.lit(n == 1), last).otherwise(other + F.when(other >= last, 1).otherwise(0))
        return F.concat(acc, F.array(nxt.cast("bigint")))

    first = F.array((draw("word", F.lit(0)) % n).cast("bigint"))
    rest = F.when(count > 1, F.sequence(F.lit(1).cast("bigint"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    picks = F.aggregate(rest, first, step)
    return phrases.select("phrase", F.posexplode(picks).alias("slot", "w")).select(
        "phrase", "slot", F.element_at(names, (F.col("w") + 1).cast("int")).alias("word"))


def compose_phrases(
    phrases: DataFrame, clips: DataFrame, glosses: Sequence[str], *, min_words: int = 2, max_words: int = 5,
    repeat_probability: float = 0.2, gap_min: int = 2, gap_max: int = 8, fps: float = 30.0, seed: int = 42,
) -> DataFrame:
    """Word boundaries of synthetic phrases: (phrase, slot, word, sample_id, gap_after, start/end frame and ms).

    ``clips(sample_id, gloss, n_frames)``. A word's clip is drawn uniformly: clips get a 0-based
    number inside their label (hash buckets, so a label with a third of the clips is no bottleneck)
    and the draw picks a number.
    """
    if gap_min < 0 or gap_max < gap_min or fps <= 0:
        raise ValueError("invalid gap range or fps")
    usable = clips.filter(F.col("gloss").isin(list(glosses)))
    sizes = {r["gloss"]: r["n"] for r in local_rows(usable.groupBy("gloss").agg(F.count(F.lit(1)).alias("n")))}
    glosses = [g for g in glosses if g in sizes]
    words = phrase_words(phrases, glosses, min_words, max_words, repeat_probability, seed)
    size_of = F.element_at(F.create_map(*[x for g in glosses for x in (F.lit(g), F.lit(sizes[g]))]), F.col("word"))
    drawn = words.withColumn("pick", hash_number(F.lit(seed), F.lit("clip"), F.col("phrase"), F.col("slot")) % size_of)
    numbered = hash_row_number(usable.select("sample_id", "gloss", "n_frames"), ["gloss"], "sample_id", seed, digits_for(max(sizes.values(), default=0)))
    # words come out of an array: the planner's size of them is that of the phrases, so no side may be broadcast by it
    chosen = drawn.hint("merge").join(numbered.select(F.col("gloss").alias("word"), F.col("rn").alias("pick"), "sample_id", "n_frames"), ["word", "pick"])
    in_phrase = W.partitionBy("phrase").orderBy("slot")  # at most max_words rows
    gap = F.lit(gap_min) + hash_number(F.lit(seed), F.lit("gap"), F.col("phrase"), F.col("slot")) % (gap_max - gap_min + 1)
    out = chosen.withColumn("gap_after", F.when(F.lead("slot").over(in_phrase).isNull(), F.lit(0)).otherwise(gap).cast("bigint"))
    out = out.withColumn("end_frame", F.sum(F.col("n_frames") + F.col("gap_after")).over(in_phrase) - F.col("gap_after") - 1)
    out = out.withColumn("start_frame", F.col("end_frame") - F.col("n_frames") + 1)
    ms = lambda f: F.rint(f / F.lit(fps) * F.lit(1000.0)).cast("bigint")
    return out.select(
        "phrase", "slot", "word", "sample_id", "n_frames", "gap_after", "start_frame", "end_frame",
        ms(F.col("start_frame")).alias("start_ms"), ms(F.col("end_frame") + 1).alias("end_ms"),
    )


def phrase_manifest(words: DataFrame) -> DataFrame:
    """One row per phrase: text, word count, total frames, sources, boundaries, gaps (≤ max_words items)."""
    item = F.struct("slot", "word", "sample_id", "gap_after", "start_frame", "end_frame", "start_ms", "end_ms")
    g = words.groupBy("phrase").agg(F.sort_array(F.collect_list(item)).alias("s"))
    n = F.size("s")
    return g.select(
        F.format_string("synthetic_phrase_%06d", "phrase").alias("sample_id"),
        F.array_join(F.transform("s", lambda x: x["word"]), " ").alias("gloss"), n.alias("word_count"),
        (F.element_at("s", -1)["end_frame"] + 1).alias("total_frames"),
        F.to_json(F.transform("s", lambda x: x["sample_id"])).alias("source_sample_ids_json"),
        F.to_json(F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in ("word", "start_frame", "end_frame", "start_ms", "end_ms")]))).alias("boundaries_json"),
        F.to_json(F.transform(F.slice("s", 1, n - 1), lambda x: x["gap_after"])).alias("gap_frames_json"),
    )


def phrase_frames(words: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of the composed clips: source frames moved to their place, gaps filled with zeros.

    ``frames(sample_id, frame_idx, f[])`` -> (phrase, frame_idx, f[], is_gap). Frames may come out of an array, and then the planner takes
    them for a small table: both joins are merge joins, so neither frames nor one row per clip go to the driver.
    """
    width = frames.groupBy("sample_id").agg(F.max(F.size("f")).alias("w"))
    real = words.join(frames.withColumnRenamed("frame_idx", "i").hint("merge"), "sample_id").select(
        "phrase", (F.col("start_frame") + F.col("i")).alias("frame_idx"), F.col("f").cast("array<double>").alias("f"), F.lit(False).alias("is_gap"))
    gaps = words.filter("gap_after > 0").join(width.hint("merge"), "sample_id").withColumn(
        "i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("gap_after")))
    ).select("phrase", (F.col("end_frame") + F.col("i")).alias("frame_idx"), F.array_repeat(F.lit(0.0), F.col("w")).alias("f"), F.lit(True).alias("is_gap"))
    return real.unionByName(gaps)


def phrase_distribution(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((word_count, phrases) histogram, one row with gap range and adjacent-repeat rate)."""
    in_phrase = W.partitionBy("phrase").orderBy("slot")
    w = words.withColumn("prev", F.lag("word").over(in_phrase)).withColumn("last", F.lead("slot").over(in_phrase).isNull())
    hist = words.groupBy("phrase").agg(F.count(F.lit(1)).alias("word_count")).groupBy("word_count").agg(F.count(F.lit(1)).alias("phrases"))
    gap = F.when(~F.col("last"), F.col("gap_after"))
    pairs = F.count("prev")
    facts = w.agg(
        F.min(gap).alias("gap_min"), F.max(gap).alias("gap_max"), F.count_distinct(gap).alias("gap_distinct"),
        pairs.alias("adjacent_pairs"), F.count_if(F.col("prev") == F.col("word")).alias("adjacent_repeats"),
    )
    rate = F.when(F.col("adjacent_pairs") > 0, F.col("adjacent_repeats") / F.col("adjacent_pairs")).otherwise(0.0)
    return hist, facts.withColumn("adjacent_repeat_rate", rate)


def phrase_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("phrase"))
