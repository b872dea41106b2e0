"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from .secrets import BASE, MORE


def _secrets() -> str:
    """Spans by the same reading of gaps and matches; RE2 takes (?s) only at the front and has no (?i: before values."""
    kinds = []
    for rank, r in enumerate(BASE + MORE, 1):
        pattern = r.pattern.replace("'", "''")
        group = lambda k, p=pattern: f"regexp_extract_all(t, '(?s)(.*?)({p})', {k})"
        kinds.append(f"select row, {rank} as rank, '{r.kind}' as kind, {r.least} as least, unnest({group(1)}) as g, unnest({group(2)}) as m, unnest({group(2 + r.value)}) as v, generate_subscripts({group(1)}, 1) as i from docs")
    return f"""
with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
found as ({' union all '.join(kinds)}),
placed as (select row, rank, kind, least, length(v) as n, length(m) as len, sum(length(g) + length(m)) over (partition by row, kind order by i) as stop from found),
spans as (select row, rank, kind, stop - len as start, stop, kind || ':' || (stop - len)::bigint || ':' || stop::bigint as s from placed where n >= least),
per as (select row, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as b, count(*) filter (kind = 'hex') as c,
  string_agg(s, ',' order by start, rank) filter (rank <= {len(BASE)}) as base, string_agg(s, ',' order by start, rank) as spans from spans group by row)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join per using (row)
"""


SECRETS = _secrets()

TOPK = """
with e as (select row_number() over () as row, vec_id, [floor(1024 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.row, q.vec_id as query_id, c.vec_id as vec_id, list_sum([a * b for a, b in list_zip(q.v, c.v)])::bigint as score
  from e q join e c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by row order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
TOPK = TOPK.replace("[a * b for a, b in list_zip(q.v, c.v)]", "list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])")

QUALITY = r"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
windows as (select row, unnest(range(1, len(w) - 1)) as i, unnest([concat_ws(' ', w[k], w[k + 1], w[k + 2]) for k in range(1, len(w) - 1)]) as s from w),
twice as (select row, i from (select row, i, count(*) over (partition by row, s) as n from windows) where n > 1),
marked as (select row, count(*) as n from (select distinct row, i + unnest([0, 1, 2]) as p from twice) group by row),
m as (select w.*, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from w left join marked using (row)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  n_symbols > 0.1 * n_words or (len(l) > 0 and n_dup_lines / greatest(len(l), 1) + 1.9208 / len(l) - 1.96 * sqrt(n_dup_lines / greatest(len(l), 1) * (1 - n_dup_lines / greatest(len(l), 1)) / len(l) + 0.9604 / (len(l)::double * len(l))) > 0.3 * (1 + 3.8416 / len(l))) or word_chars < 2.5 * n_words or word_chars > 12.0 * n_words
  or len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 0.7 * n_words
  or length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > 0.5 * length(regexp_replace(t, '[^\p{L}]+', '', 'g'))
  or len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))) > 0.5 * len(l)
  or len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 0.9 * len(l) as failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and not failed as kept from v
"""
