"""SQL for the two vector queries: rounds of assignment and replacement written out one after the other."""

from __future__ import annotations

SQUARES = "list_sum(list_transform(list_zip(p, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
FINITE = "len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """``near`` packs distance and entry into one number, so that its minimum breaks ties."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select i, part, min({entries} * {SQUARES} + e) as near from parts join books{r} using (part) group by i, part)")
        if r < rounds:
            steps.append(f"""m{r} as materialized (select part, near % {entries} as e, k, cast(floor(sum(p[k]) / count(*)) as bigint) as m
  from a{r} join parts using (i, part), range(1, (select max(len(p)) + 1 from parts)) as s(k) group by 1, 2, 3)""")
            steps.append(f"""books{r + 1} as materialized (select part, e, coalesce(n, c) as c
  from books{r} left join (select part, e, list(m order by k) as n from m{r} group by 1, 2) using (part, e))""")
    return f"""
with kept as materialized (select vec_id, label, row_number() over (order by vec_id) - 1 as i, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
  from embeddings where {FINITE}),
parts as materialized (select i, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] as p from kept, range({parts}) as s(part)),
books0 as materialized (select part, i as e, p as c from parts where i < {entries}),
{", ".join(steps)},
coded as (select i, string_agg(printf('%02x', near % {entries}), '' order by part) as code, cast(sum(near // {entries}) as bigint) as error from a{rounds} group by i),
labelled as (select vec_id, label, code, error from coded join kept using (i)),
totals as (select label as of, cast(sum(error) as bigint) as label_error from labelled group by label),
digest as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) as codebooks_sha256 from books{rounds})
select vec_id, code, error, label_error, codebooks_sha256 from labelled join totals on label is not distinct from of, digest
"""


def clusters(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:") -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select i, any_value(p) as p, min({k} * {SQUARES} + j) as near from kept, centres{r} group by i)")
        if r < rounds:
            steps.append(f"""m{r} as materialized (select near % {k} as j, k, cast(floor(sum(p[k]) / count(*)) as bigint) as m from a{r}, range(1, {dim + 1}) as s(k) group by 1, 2)""")
            steps.append(f"""centres{r + 1} as materialized (select j, coalesce(n, c) as c from centres{r} left join (select j, list(m order by k) as n from m{r} group by 1) using (j))""")
    return f"""
with kept as materialized (select vec_id, row_number() over (order by vec_id) as i, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as p
  from embeddings where len(embedding) = {dim} and {FINITE}),
centres0 as materialized (select row_number() over (order by sha256('{seed}' || vec_id)) - 1 as j, p as c from kept order by sha256('{seed}' || vec_id) limit {k}),
{", ".join(steps)},
placed as (select vec_id, cast(near % {k} as integer) as cluster, cast(near // {k} as bigint) as distance from a{rounds} join kept using (i)),
held as (select cluster as of, cast(sum(distance) as bigint) as cluster_inertia from placed group by cluster),
digests as (select cast(j as integer) as of, sha256(array_to_string(c, ',')) as centroid_sha256 from centres{rounds})
select vec_id, cluster, distance, cluster_inertia, (select cast(sum(distance) as bigint) from placed) as inertia, centroid_sha256
from placed join held on cluster = held.of join digests on cluster = digests.of
"""
