"""Label contract: collisions, aliases, allowlist joins, anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.constants import CONTRACT_SIZE
from clipmill.functions.text import canonicalize_text, in_labels, normalize_gloss, strip
from clipmill.session import local_rows


def label_list(labels: DataFrame) -> list[str]:
    """Contract labels in order, on the driver: the user's own list."""
    rows = local_rows(labels.select("ord", "label"))
    return [r["label"] for r in sorted(rows, key=lambda r: r["ord"])]


def contract_checks(labels: DataFrame, size: int = CONTRACT_SIZE, version: str | None = None) -> DataFrame:
    """Violations (rule, key, detail) of a label contract: size, uniqueness, blanks, and the version where one is asked for."""
    blank = strip(F.coalesce(F.col("label"), F.lit(""))) == ""
    facts = labels.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("d"), F.count_if(blank).alias("b"),
        (F.max("version") if version is not None else F.lit(None).cast("string")).alias("v"),
    )
    rules = F.array(
        F.when(F.col("n") != size, F.struct(F.lit("size").alias("rule"), F.col("n").cast("string").alias("detail"))),
        F.when(F.col("d") != F.col("n"), F.struct(F.lit("unique").alias("rule"), F.col("d").cast("string").alias("detail"))),
        F.when(F.col("b") > 0, F.struct(F.lit("blank").alias("rule"), F.col("b").cast("string").alias("detail"))),
        F.when(F.lit(version is not None) & ~F.col("v").eqNullSafe(F.lit(version)), F.struct(F.lit("version").alias("rule"), F.coalesce("v", F.lit("")).alias("detail"))),
    )
    return facts.select(F.explode(F.array_compact(rules)).alias("r")).select(
        "r.rule", F.lit("labels").alias("key"), "r.detail"
    )


def label_collisions(labels: DataFrame, original: str) -> DataFrame:
    """Rows (label, original) where distinct originals normalise to one label. No sets are built."""
    pairs = labels.select(F.col(original).alias("original"), normalize_gloss(F.col(original)).alias("label")).distinct()
    clash = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return pairs.join(clash.select("label"), "label", "left_semi").select("label", "original")


def flatten_aliases(canonicals: DataFrame, labels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(canonical, aliases[])`` -> ((alias, canonical), violations)."""
    norm = canonicals.select(normalize_gloss(F.col("canonical")).alias("canonical"), "aliases")
    known = in_labels(F.col("canonical"), labels)
    pairs = (
        norm.filter(known)
        .select("canonical", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("raw"))
        .select(normalize_gloss(F.col("raw")).alias("alias"), "canonical")
        .filter("alias <> ''")
        .distinct()
    )
    clash = pairs.groupBy("alias").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bad = norm.filter(~known).select(
        F.lit("canonical_not_in_allowlist").alias("rule"), F.col("canonical").alias("key"), F.lit("").alias("detail")
    ).unionByName(
        pairs.join(clash, "alias").select(
            F.lit("alias_collision").alias("rule"), F.col("alias").alias("key"), F.col("canonical").alias("detail")
        )
    )
    return pairs, bad


def last_of(df: DataFrame, value: str) -> Column:
    """The value that stands for a repeated key: of the last row by ``ord``, without that column the greatest."""
    return F.max_by(value, "ord") if "ord" in df.columns else F.max(value)


def alias_table(aliases: DataFrame) -> DataFrame:
    """(_a, _c): both sides normalised, blank ones dropped, each alias once; of repeats the last row counts."""
    norm = aliases.withColumn("_a", normalize_gloss(F.col("alias"))).withColumn("_c", normalize_gloss(F.col("canonical")))
    return norm.filter("_a <> '' and _c <> ''").groupBy("_a").agg(last_of(norm, "_c").alias("_c"))


def alias_canonicalize(df: DataFrame, raw: Column, aliases: DataFrame, labels: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: the label for ``raw`` after one alias step, null when blank or not allowed."""
    lookup = alias_table(aliases)
    return lookup_alias(df.withColumn("_n", normalize_gloss(raw)), "_n", lookup, labels, out).drop("_n")


def lookup_alias(df: DataFrame, norm: str, lookup: DataFrame, labels: Sequence[str], out: str) -> DataFrame:
    """As above over an already normalised column and a prepared ``(_a, _c)`` lookup."""
    joined = df.join(lookup, F.col(norm) == F.col("_a"), "left")
    label = F.coalesce("_c", norm)
    return joined.withColumn(out, F.when(in_labels(label, labels) & (F.col(norm) != ""), label)).drop("_a", "_c")


def resolve_output_alias(df: DataFrame, line: Column, aliases: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Add status, prediction, candidate for a line normalised by the apostrophe-keeping rule."""
    lookup = alias_table(aliases)
    joined = df.withColumn("_n", line).join(lookup, F.col("_n") == F.col("_a"), "left")
    label = F.coalesce("_c", "_n")
    ok = in_labels(label, labels)
    return joined.select(
        *df.columns,
        F.when(ok, "ok").otherwise("out_of_allowlist").alias("status"),
        F.when(ok, label).alias("prediction"),
        F.nullif(label, F.lit("")).alias("candidate"),
        F.when(ok, "in_allowlist").otherwise("not_in_allowlist").alias("reason"),
    )


def filter_to_contract(df: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """Rows whose label is in the contract, with the contract position ``ord``."""
    return df.join(labels.select(F.col("label").alias(label), "ord"), label)


def map_source_labels(
    df: DataFrame, label: str, overrides: DataFrame, substitutions: DataFrame, labels: Sequence[str]
) -> DataFrame:
    """Source label -> (override) -> (training substitution); rows outside the contract are dropped."""
    src = df.withColumn("_n", canonicalize_text(F.col(label)))
    over = overrides.groupBy(canonicalize_text(F.col("source")).alias("_n")).agg(last_of(overrides, "canonical").alias("_o"))
    subst = substitutions.groupBy(F.col("canonical").alias("_m")).agg(last_of(substitutions, "preferred").alias("_p"))
    out = src.join(over, "_n", "left").withColumn("_m", F.coalesce("_o", "_n")).join(subst, "_m", "left")
    return (
        out.withColumn("mapped", F.coalesce("_p", "_m"))
        .filter(in_labels(F.col("mapped"), labels) | in_labels(F.col("_m"), labels))
        .drop("_n", "_o", "_m", "_p")
    )


def split_row_check(df: DataFrame, label: str, split: str, file_split: str, labels: Sequence[str]) -> DataFrame:
    """Add ``label``-rule flags: split_ok, label_ok, kept. Callers drop and count, or require all kept."""
    split_ok = canonicalize_text(F.coalesce(F.col(split), F.col(file_split))) == F.col(file_split)
    label_ok = in_labels(canonicalize_text(F.col(label)), labels)
    return df.withColumn("split_ok", split_ok).withColumn("label_ok", label_ok).withColumn(
        "kept", F.col("split_ok") & F.col("label_ok")
    )


def top_k_anchors(df: DataFrame, output: str, labels: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """((gloss, count) of the k most frequent labels, ties lexical; rows outside the contract)."""
    if k <= 0:
        raise ValueError("k must be positive")
    seen = df.filter(F.col(output).isNotNull()).withColumn("_g", normalize_gloss(F.col(output)))
    known = in_labels(F.col("_g"), labels)
    top = (
        seen.filter(known).groupBy(F.col("_g").alias("gloss")).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("gloss")).limit(k)
    )
    return top, seen.filter(~known).drop("_g")


def anchor_contract(df: DataFrame, output: str, labels: Sequence[str], aliases: DataFrame, k: int) -> DataFrame:
    """One row: allowlist, anchors, alias rows, rule flags, record count, version."""
    top, _ = top_k_anchors(df, output, labels, k)
    anchors = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "gloss"))).alias("anchors"))
    names = alias_table(aliases).agg(F.sort_array(F.collect_list(F.struct(F.col("_c").alias("canonical"), F.col("_a").alias("alias")))).alias("alias_map"))
    count = df.agg(F.count(F.lit(1)).alias("record_count"))
    return beside(a=anchors, b=names, c=count).select(
        F.lit("colab_top50_anchor_contract_v1").alias("contract_version"),
        F.lit(k).alias("top_k"),
        F.col("c.record_count").alias("record_count"),
        F.array(*[F.lit(x) for x in labels]).alias("allowlist"),
        F.transform("a.anchors", lambda x: F.struct(x["gloss"].alias("gloss"), (-x["n"]).alias("count"))).alias("anchors"),
        F.transform("b.alias_map", lambda x: F.struct(x["alias"].alias("alias"), x["canonical"].alias("canonical"))).alias("alias_map"),
        F.struct(
            F.lit(True).alias("lowercase"), F.lit(True).alias("strip_outer_backticks"),
            F.lit(True).alias("strip_non_alnum_underscore_space_hyphen"), F.lit(True).alias("collapse_whitespace"),
            F.lit("normalized_exact_with_alias_map").alias("comparison"),
        ).alias("normalization_rules"),
    )


def beside(**one_row: DataFrame) -> DataFrame:
    """Put one-row tables side by side as struct columns, without a join."""
    parts = None
    for name, df in one_row.items():
        row = df.select(F.struct(*df.columns).alias(name))
        parts = row if parts is None else parts.unionByName(row, allowMissingColumns=True)
    return parts.agg(*[F.first(n, ignorenulls=True).alias(n) for n in one_row])
