"""Language identification by Bayesian fusion of evidence.

* **Text**: multinomial likelihood of byte trigrams (2^16 hashed coordinates), counted over all labelled documents by language.
  Neighbouring trigrams are not independent, so the log likelihood counts as that of at most ``TEXT_WEIGHT`` of them.
* **Declared markup language** and **address suffix**: likelihoods of the value given the language, from grouped sums of the text posteriors
  of all rows, smoothed; a declared code that names a known language starts with pseudo counts on that language.
* **Host**: a prior smoothed down the hierarchy all rows, domain, host. The row's own posterior is taken out of the sums, so a
  page alone on its host is judged by the levels above it.

The sums are partial aggregates with one column per language, so a host with a third of all rows is one small row per task.
Missing evidence (null or empty text, no address, no declaration) adds nothing. Languages are the distinct labels
(at most ``MAX_LANGS``, else an error), in code-point order, which also settles ties. Repeated rows are rows of
their own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.llm.words import LOWER, buffers, pieces
from clipmill.session import stored

BITS, MAX_LANGS = 16, 256
#: A text counts as at most so many independent trigrams; pseudo counts of the smoothing steps, and of a declaration's face value.
TEXT_WEIGHT, PULL, FACE = 40.0, 5.0, 20.0


def coordinates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram that ends at each byte, and whether it lies within its text."""
    b = LOWER[data].astype(np.uint32)
    key = b.copy()
    key[1:] |= b[:-1] << 8
    key[2:] |= b[:-2] << 16
    at = ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    whole = np.ones(len(b), bool)
    for j in range(2):
        first = offsets[:-1] + j
        whole[first[first < offsets[1:]]] = False
    return at, whole


def train(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each trigram coordinate (2^16 x languages)."""
    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                at, whole = coordinates(*(found := buffers(part.column(1))))
                names, code = np.unique(np.array(part.column(0).to_pylist(), dtype=object), return_inverse=True)
                code = np.repeat(code, np.diff(found[1]))
                n = np.bincount((code[whole] << BITS) + at[whole], minlength=len(names) << BITS).reshape(len(names), -1)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + n[k]
        for name, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen].astype(np.int64))], names=["lang", "at", "n"])

    counts = stored(labelled.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")), "language-counts")
    langs = [r.lang for r in counts.select("lang").distinct().limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs.sort()
    table = np.zeros((1 << BITS, max(1, len(langs))))
    rows = counts.toPandas()  # at most MAX_LANGS * 2^16 rows
    if len(rows):
        table[rows["at"].to_numpy(), np.searchsorted(langs, rows["lang"].to_numpy(str))] = rows["n"]
    table += 0.5
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def text_evidence(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``rows`` without their text, with ``ll``: the weighted log likelihood of the text by language."""
    sent = rows.sparkSession.sparkContext.broadcast(table)
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        model = sent.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                column = part.column(part.schema.get_field_index("text"))
                data, off = buffers(column)
                at, whole = coordinates(data, off)
                out = np.zeros((len(column), model.shape[1]))
                n = np.diff(np.concatenate([[0], np.cumsum(whole)])[off])
                for k in range(model.shape[1]):
                    run_sum = np.concatenate([[0.0], np.cumsum(np.where(whole, model[at, k], 0), dtype=np.float64)])
                    out[:, k] = run_sum[off[1:]] - run_sum[off[:-1]]
                out *= (np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1))[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * model.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), lists], names=[*names, "ll"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "ll array<double>"]))


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    raised = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def _sums(rows: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """Text posteriors summed by the keys, as one array."""
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(k)])
    return sums.select(*keys, F.array(*[F.col(f"s{i}") for i in range(k)]).alias(name))


def fuse(rows: DataFrame, langs: list[str]) -> DataFrame:
    """``rows`` (declared, suffix, domain, host, ll) with ``lang``, ``confidence`` and ``text_lang``."""
    k = len(langs)
    names = F.array(*[F.lit(x) for x in langs])
    rows = stored(rows.withColumn("post", _softmax(F.col("ll"))), "language-text")
    every = rows.agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k)]).first()
    total = [float(x) for x in every]
    base = F.array(*[F.lit((t + 1) / (sum(total) + k)) for t in total])
    joined = rows
    for key in ("declared", "suffix", "domain", "host"):
        keys = ["domain", "host"] if key == "host" else [key]
        sums = _sums(rows.filter(F.col(key).isNotNull()), keys, k, f"by_{key}")
        joined = joined.join(sums, keys, "left")
    # likelihood of a declared code or suffix: (sum of the value for a language + its smoothing) / (sum of the language)
    spread = len(langs) + 1.0
    own = lambda i: F.col("post")[i]
    terms = []
    for i, lang in enumerate(langs):
        face = F.when(F.col("declared") == lang, F.lit(FACE)).otherwise(0.0)
        declared = F.log((F.col("by_declared")[i] - own(i) + face + 1 / spread) / (F.lit(total[i]) - own(i) + FACE + 1))
        suffix = F.log((F.col("by_suffix")[i] - own(i) + PULL / spread) / (F.lit(total[i]) - own(i) + PULL))
        terms.append((declared, suffix))
    less = lambda sums: F.transform(F.arrays_zip(sums.alias("a"), F.col("post").alias("b")), lambda z: F.greatest(z["a"] - z["b"], F.lit(0.0)))
    mass = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    smooth = lambda sums, above: F.transform(F.arrays_zip(sums.alias("a"), above.alias("b")), lambda z: (z["a"] + PULL * z["b"]) / (mass(sums) + PULL))
    joined = joined.withColumn("__d", F.when(F.col("by_domain").isNotNull(), less(F.col("by_domain")))).withColumn("__h", F.when(F.col("by_host").isNotNull(), less(F.col("by_host"))))
    joined = joined.withColumn("__base", base)
    joined = joined.withColumn("__domain", F.when(F.col("__d").isNull(), F.col("__base")).otherwise(smooth(F.col("__d"), F.col("__base"))))
    joined = joined.withColumn("__prior", F.when(F.col("__h").isNull(), F.col("__domain")).otherwise(smooth(F.col("__h"), F.col("__domain"))))
    score = F.array(*[
        F.col("ll")[i] + F.log(F.col("__prior")[i]) + F.coalesce(d, F.lit(0.0)) + F.coalesce(s, F.lit(0.0)) for i, (d, s) in enumerate(terms)])
    best = lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))
    joined = joined.withColumn("__score", score)
    joined = joined.withColumn("__final", _softmax(F.col("__score")))
    return joined.withColumns({"lang": best(F.col("__score")), "confidence": F.array_max("__final"), "text_lang": best(F.col("ll"))})


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments, navigation and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, suffix, domain, host) of web pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    tag = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", 1))
    parts = F.split(host, r"\.")
    return pages.select(
        "page_id", visible_text(F.col("html")).alias("text"), F.when(tag != "", tag).alias("declared"),
        F.element_at(parts, -1).alias("suffix"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".").alias("domain"), host.alias("host"))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per page and per document: page_id, doc_id, lang, confidence, text_lang, declared, host.

    ``docs`` give the text model by their labels. As rows to identify they have no markup or address; their source is their host.
    """
    langs, table = train(docs, text_col, lang_col)
    names = ["page_id", "doc_id", "declared", "suffix", "domain", "host", "text"]
    page_type, doc_type = (t.schema[c].dataType.simpleString() for t, c in ((pages, "page_id"), (docs, id_col)))
    none = lambda kind="string": F.lit(None).cast(kind)
    own = page_rows(pages).withColumn("doc_id", none(doc_type)).select(*names)
    others = docs.select(
        none(page_type).alias("page_id"), F.col(id_col).alias("doc_id"), none().alias("declared"), none().alias("suffix"), none().alias("domain"),
        F.col(source_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    both = own.unionByName(others)
    if not langs:
        return both.select("page_id", "doc_id", none().alias("lang"), none("double").alias("confidence"), none().alias("text_lang"), "declared", "host")
    scored = text_evidence(both.withColumn("domain", F.coalesce("domain", F.when(F.col("host").isNotNull(), F.lit("")))), langs, table)
    return fuse(scored, langs).select("page_id", "doc_id", "lang", "confidence", "text_lang", "declared", "host")
