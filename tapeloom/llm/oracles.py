"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from tapeloom.llm import secrets

_URLS = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY host, path
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
"""


def _shares(name: str, path: list[str], above: str) -> str:
    """CTEs that share the budget of ``above`` (columns of ``path`` but the last, and t) among the children."""
    keys, up = ", ".join(path), path[:-1]
    parent = f"PARTITION BY {', '.join(up)}" if up else ""
    join = " AND ".join(f"n.{k} IS NOT DISTINCT FROM a.{k}" for k in up) or "true"
    before = f"OVER ({parent} ORDER BY c::DOUBLE / w NULLS FIRST, {', '.join(f'{k} NULLS FIRST' for k in path)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_n AS (SELECT {keys}, sum(capacity)::HUGEINT AS c, max(w_{path[-1]})::HUGEINT AS w FROM leaf GROUP BY {keys}),
{name}_s AS (
  SELECT n.*, least(a.t, sum(c) OVER ({parent.replace('PARTITION BY ', 'PARTITION BY n.').replace(', ', ', n.')}))::HUGEINT AS t FROM {name}_n n JOIN {above} a ON {join}
),
{name}_o AS (SELECT *, coalesce(sum(c) {before}, 0)::HUGEINT AS c0, (sum(w) OVER ({parent}) - coalesce(sum(w) {before}, 0))::HUGEINT AS w1 FROM {name}_s),
{name}_r AS (
  SELECT *, min(CASE WHEN c * w1 > (t - c0) * w THEN c0 END) OVER ({parent}) AS r0, max(CASE WHEN c * w1 > (t - c0) * w THEN w1 END) OVER ({parent}) AS r1 FROM {name}_o
),
{name} AS (SELECT {keys}, least(c, CASE WHEN c * w1 > (t - c0) * w OR c0 > r0 THEN (t - r0) * w // r1 ELSE c END)::HUGEINT AS t FROM {name}_r)"""


_MIX = (
    r"""
WITH d AS (
  SELECT doc_id, lang, source, CASE WHEN number = '' THEN 'other' ELSE 'domain' || (number::BIGINT % 4) END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM (SELECT *, regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS number FROM documents)
), leaf AS (
  SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * 3 AS capacity, 1 AS w_domain,
         CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'es' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w_lang, 1 AS w_source
  FROM d GROUP BY ALL
), top AS (SELECT floor(sum(tokens) * 0.5)::HUGEINT AS t FROM leaf),"""
    + ",".join(_shares(name, path, above) for name, path, above in (("s1", ["domain"], "top"), ("s2", ["domain", "lang"], "s1"), ("s3", ["domain", "lang", "source"], "s2")))
    + r""",
e AS (
  SELECT d.*, epoch, s3.t - epoch * leaf.tokens AS give,
         coalesce(sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source, epoch
           ORDER BY md5(concat_ws('|', 'mix', epoch::VARCHAR, coalesce(d.doc_id::VARCHAR, ''))), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM d JOIN leaf ON d.domain = leaf.domain AND d.lang IS NOT DISTINCT FROM leaf.lang AND d.source IS NOT DISTINCT FROM leaf.source
  JOIN s3 ON d.domain = s3.domain AND d.lang IS NOT DISTINCT FROM s3.lang AND d.source IS NOT DISTINCT FROM s3.source, range(3) AS x(epoch)
  WHERE leaf.tokens > 0
)
SELECT doc_id, domain, lang, source, tokens, epoch::INTEGER AS epoch FROM e WHERE give > 0 AND (run < give OR give >= (SELECT max(leaf.tokens) FROM leaf WHERE leaf.domain = e.domain AND leaf.lang IS NOT DISTINCT FROM e.lang AND leaf.source IS NOT DISTINCT FROM e.source))
"""
)

_MIDDLES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s
  FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d
), f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM h
), c AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""


def _found(number: int, part: str, pattern: str, strong: str = "false") -> str:
    """Matches of one pattern with their places; ``strong`` judges a match x."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT rid, {number} AS g, '{part}' AS part, {strong.replace("PATTERN", quoted)} AS strong, x, gap, i FROM (
    SELECT rid, unnest(f) AS x, unnest(list_transform(s[1:len(f)], lambda y: length(y))) AS gap, unnest(range(len(f))) AS i
    FROM (SELECT rid, regexp_extract_all(t, {quoted}, 0) AS f, string_split_regex(t, {quoted}) AS s FROM d)
  )"""


_NEAR = "EXISTS (FROM k AS y WHERE y.rid = x.rid AND y.part IN ({parts}) AND y.a <= x.b + 300 AND y.b >= x.a - 300 AND NOT EXISTS (FROM k AS z WHERE z.rid = x.rid AND z.part = 'break' AND z.a >= least(x.b, y.b) AND z.b <= greatest(x.a, y.a)))"
_SECRETS = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join([
    _found(0, "assign", secrets.ASSIGN, "length(regexp_extract(x, PATTERN, 2)) >= 8"), _found(1, "access", secrets.ACCESS, "length(x) >= 16"), _found(2, "hex", secrets.HEX, "length(x) >= 32"),
    *[_found(3 + k, part, pattern) for k, (part, pattern) in enumerate(secrets.WEAK)],
])}),
named AS (SELECT rid FROM d WHERE regexp_matches(t, '{secrets.IDENTIFIER.replace("'", "''")}') OR contains(t, 'AKIA')),
placed AS (
  SELECT rid, g, part, strong, x, b - length(x) AS a, b FROM (SELECT *, sum(gap + length(x)) OVER (PARTITION BY rid, g ORDER BY i) AS b FROM m)
),
p AS MATERIALIZED (
  SELECT * FROM placed WHERE (g < 3 OR rid IN (FROM named)) AND NOT (part = 'hex' AND NOT strong AND NOT (regexp_matches(x, '[a-f]') AND regexp_matches(x, '[0-9]')))
),
k AS MATERIALIZED (
  FROM p WHERE strong OR part = 'break' OR NOT EXISTS (
    FROM p AS y WHERE y.rid = p.rid AND y.a < p.b AND y.b > p.a AND (y.strong OR (p.part = 'unlabelled' AND y.part = 'identifier')))
),
told AS (
  SELECT rid, a, b, CASE WHEN strong OR part IN ('identifier', 'endpoint') THEN part WHEN part = 'access' THEN 'identifier' ELSE 'secret' END AS kind
  FROM (SELECT *, {_NEAR.format(parts="'access', 'identifier'")} AS near_i, {_NEAR.format(parts="'assign', 'hex', 'labelled', 'unlabelled'")} AS near_s FROM k AS x)
  WHERE part <> 'break' AND CASE WHEN strong THEN true WHEN part IN ('access', 'identifier') THEN near_s WHEN part = 'endpoint' THEN near_i AND near_s ELSE near_i END
),
r AS (SELECT rid, kind, a, list_position(['assign', 'access', 'hex', 'identifier', 'secret', 'endpoint'], kind) AS place, kind || ':' || a::BIGINT || ':' || b::BIGINT AS s, b FROM told)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY a, place, b) FILTER (place <= 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, place, b), '') AS spans
FROM d LEFT JOIN r USING (rid) GROUP BY rid, doc_id
"""

ORACLES: dict[str, str] = {"op2_url_filter": _URLS, "op8_source_mixing": _MIX, "op12_secret_scan": _SECRETS, "op13_fill_in_middle": _MIDDLES}
