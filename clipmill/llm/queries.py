"""The registered queries of this subpackage: thin forms of its operators over the driver tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clipmill.llm import bpe, centroids, exact_dedup, jaccard_join, language, licenses, minmax, mixing, quality, secrets, token_files, toxicity, vector_codes, vector_sql

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every document with its language."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return language.identify(pages, _documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the secrets in its text and in what its text encodes."""
    return secrets.secrets(_documents(spark, sf_dir))


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoded text, as digests."""
    return bpe.encode_decode(_documents(spark, sf_dir), str(public_tokenizers.path("word_bpe_49k.json")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score, learnt from the labelled documents outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.score_with_labels(_documents(spark, sf_dir), labels)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licenses found in it."""
    return licenses.licenses(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays of its group of equal texts."""
    return exact_dedup.exact_groups(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from d group by norm)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.norm) as text_sha256 from d join g on d.norm = g.norm
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its rule counts and the verdict of the perplexity bands."""
    return quality.quality(_documents(spark, sf_dir))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from d group by source),
b as (select cast(sum(source_size) as bigint) as budget from s),
ranked as (select *, 3 * source_size / weight as cap_level, row_number() over (order by 3 * source_size / weight, source nulls last) as k from s),
levels as (select k, cap_level,
  (budget - coalesce(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by k rows between current row and unbounded following) as level from ranked, b),
w as (select level from levels where level <= cap_level order by k limit 1),
t as (select source, source_size, least(level * weight, 3.0::double * source_size) as target from s, w),
q as (select doc_id, d.source, size, source_size, target, md5('mix|' || cast(doc_id as varchar)) as key from d join t on d.source is not distinct from t.source),
r as (select *, sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and current row) as upto,
  row_number() over (partition by source order by key, doc_id, size) as n from q),
c as (select doc_id, n, source, size, key, copy, (upto + copy * source_size)::double / target as finish from r, (values (0), (1), (2)) as v(copy) where size > 0),
m as (select *, sum(size) over (order by finish, key, doc_id, n, copy rows between unbounded preceding and current row) as run from c),
got as (select doc_id, n, source, cast(sum(size) as bigint) as taken from m, b where run <= budget group by doc_id, n, source)
select r.doc_id, r.size, r.source_size, r.target, coalesce(got.taken, 0)::bigint as taken
from r left join got on r.doc_id = got.doc_id and r.n = got.n and r.source is not distinct from got.source
"""

def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum, read back from the files its ids were written to."""
    manifest = token_files.write_ids(_documents(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")), end_id=0)
    return token_files.read_back(manifest)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id that links of word-shingle sets reach from it."""
    return jaccard_join.jaccard_components(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as set_of from t),
n as (select doc_id, cast(len(set_of) as bigint) as n_shingles from g),
e as (select doc_id, unnest(set_of) as s from g),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from e a join e b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * common >= 90 * (x.n_shingles + y.n_shingles - common)),
reach as (select doc_id, doc_id as other from n union select r.doc_id, l.b from reach r join links l on r.other = l.a),
c as (select doc_id, min(other) as component_id from reach group by 1)
select n.doc_id, n_shingles, component_id from n join c on n.doc_id = c.doc_id
"""


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector with its product code and error."""
    coded = vector_codes.vector_codes(_embeddings(spark, sf_dir))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id that near-copy links reach from it."""
    return minmax.near_groups(_documents(spark, sf_dir))


OP12_SQL = r"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as set_of from t),
n as (select doc_id, cast(len(set_of) as bigint) as n_shingles from g),
e as (select doc_id, unnest(set_of) as s from g),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from e a join e b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
reach as (select doc_id, doc_id as other from n union select r.doc_id, l.b from reach r join links l on r.other = l.a),
c as (select doc_id, min(other) as component_id from reach group by 1)
select n.doc_id, n_shingles, component_id, n.doc_id = component_id as kept from n join c on n.doc_id = c.doc_id
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector with its cluster."""
    return centroids.centroids(_embeddings(spark, sf_dir))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_language_id": (op1_language_id, None),
    "op2_secret_scan": (op2_secret_scan, None),
    "op3_bpe_encode_decode": (op3_bpe_encode_decode, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_license_scan": (op5_license_scan, None),
    "op6_exact_dedup": (op6_exact_dedup, OP6_SQL),
    "op7_quality_rules": (op7_quality_rules, None),
    "op8_mix_sources": (op8_mix_sources, OP8_SQL),
    "op9_token_files": (op9_token_files, None),
    "op10_ngram_jaccard_join": (op10_ngram_jaccard_join, OP10_SQL),
    "op11_vector_codes": (op11_vector_codes, vector_sql.codes()),
    "op12_minmax_dedup": (op12_minmax_dedup, OP12_SQL),
    "op13_centroids": (op13_centroids, vector_sql.clusters()),
}


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
