"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '\\A([^/?#]*)([^?#]*)', 1), {UPPER_LOWER}) AS host,
             regexp_extract(rest, '\\A([^/?#]*)([^?#]*)', 2) AS path FROM u),
r(verdict, h, pre) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT p.page_id, p.host, p.path,
             (SELECT arg_max(h || pre, length(h || pre)) FROM r WHERE ends_with('.' || host, '.' || h) AND starts_with(path, pre)) AS rule
      FROM p)
SELECT page_id, host, path, rule,
       coalesce((SELECT verdict FROM r WHERE h || pre = m.rule),
                CASE WHEN ends_with(path, '.exe') OR contains(path, '/wp-login.php') OR contains('.' || host, '.doubleclick.')
                          OR regexp_matches(host, '\\A(?s:ads.\\.)') THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""

OP2 = r"""
WITH toks AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
pats AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS p
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
grams AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
          FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM toks, (SELECT DISTINCT m FROM pats))),
occ AS (SELECT doc_id, i, grams.m AS m, item_id FROM grams JOIN pats ON g = p AND grams.m = pats.m),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM toks t LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""




def _spans(kind: str, rank: int, pattern: str, valid: str, group: int = 0) -> str:
    """Rows (doc_id, b, rank, e, kind) of one kind: running sums of gaps and matches give the places."""
    return f"""
{kind}_m AS (SELECT doc_id, m, gap, i, {'grp' if group else 'm'} AS g FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, {f"unnest(regexp_extract_all(t, '{pattern}', {group})) AS grp," if group else ''}
  unnest(string_split_regex(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}'))]) AS gap, generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS i FROM d) x),
{kind}_s AS (SELECT doc_id, m, g, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM {kind}_m),
{kind} AS (SELECT doc_id, e - length(m) AS b, {rank} AS rank, e, '{kind}' AS kind, m FROM {kind}_s WHERE {valid})"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT) WHEN CAST(reverse({_DIGITS})[i] AS INT) > 4 THEN 2 * CAST(reverse({_DIGITS})[i] AS INT) - 9 ELSE 2 * CAST(reverse({_DIGITS})[i] AS INT) END)) % 10 = 0"
_TURNED = "substr(m, 5) || left(m, 4)"
_NUMBER = f"array_to_string(list_transform(regexp_extract_all({_TURNED}, '[A-Z0-9]'), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
_MOD97 = f"list_reduce(list_transform(regexp_extract_all({_NUMBER}, '[0-9]'), lambda c: CAST(c AS INT)), lambda a, x: (a * 10 + x) % 97, 0) = 1"
_NEAR = "lower(substr(t, greatest(b - 40, 0) + 1, e - b + 80))"
_NEAR_SSN = f"regexp_matches({_NEAR}, 'ssn|social security|taxpayer')"


def _digest(kinds: tuple[str, ...], found: str) -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    base = ", ".join(f"'{k}'" for k in kinds)
    one = "kind || ':' || b || ':' || e"
    return f"""SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY b, rank, e) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg({one}, ',' ORDER BY b, rank, e), '') AS spans
FROM d LEFT JOIN {found} USING (doc_id) GROUP BY d.doc_id"""


OP4 = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)," + ",".join(
    (
        _spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _spans("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"regexp_full_match(m, '(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')"),
        _spans("card", 2, r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
        _spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
        _spans("iban", 4, r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", "length(m) = map { 'AT': 20, 'BE': 16, 'CH': 21, 'CZ': 24, 'DE': 22, 'DK': 18, 'ES': 24, 'FI': 18, 'FR': 27, 'GB': 22, 'GR': 27, 'HU': 28, 'IE': 22, 'IT': 27, 'LU': 20, 'NL': 18, 'NO': 15, 'PL': 28, 'PT': 25, 'SE': 24 }[left(m, 2)] AND " + _MOD97),
        _spans("ssn", 5, r"[0-9]+-[0-9]+-[0-9]+", r"regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
    )
) + f""", every AS (FROM email UNION ALL FROM ip UNION ALL FROM card UNION ALL FROM phone UNION ALL FROM iban UNION ALL SELECT ssn.* FROM ssn JOIN d USING (doc_id) WHERE {_NEAR_SSN})
""" + _digest(("email", "ip", "card", "phone"), "every")  # fmt: skip

_ENTROPY = r"""
dense AS (SELECT DISTINCT doc_id, b, rank, e, kind, m, h FROM (SELECT *, regexp_full_match(m, '[0-9A-Fa-f]+') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Fa-f]') AS h FROM entropy)
  WHERE (h OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')))
    AND NOT regexp_matches(m, '(?i)example|sample|placeholder|changeme|dummy|xxxx|0{8}|1234567|abcdefg|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')),
win AS (SELECT doc_id, b, e, h, w, c, count(*) AS n FROM (SELECT doc_id, b, e, h, w, unnest(string_split(substr(m, w, 20), '')) AS c FROM (SELECT *, unnest(range(1, length(m) - 18)) AS w FROM dense)) GROUP BY ALL),
bits AS (SELECT doc_id, b, e, h, w, -sum(n / 20.0 * log2(n / 20.0)) AS bits FROM win GROUP BY ALL),
sure AS (SELECT doc_id, b, e, h, max(bits) AS bits FROM bits GROUP BY ALL),
base AS (FROM assign UNION ALL FROM access UNION ALL FROM hex),
more AS (SELECT dense.doc_id, dense.b, dense.rank, dense.e, dense.kind, dense.m FROM dense JOIN sure USING (doc_id, b, e) WHERE bits >= CASE WHEN dense.h THEN 3.2 ELSE 3.8 END - 1e-9
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = dense.doc_id AND base.b < dense.e AND dense.b < base.e)),
every AS (FROM base UNION ALL FROM more)
"""

OP7 = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)," + ",".join(
    (
        _spans("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 12", 1),
        _spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 18"), _spans("hex", 2, "[0-9a-f]+", "length(m) >= 16"), _spans("entropy", 3, "[A-Za-z0-9+/_=-]{20,}", "true"),
    )
) + "," + _ENTROPY + _digest(("assign", "access", "hex"), "every")

_COMPONENTS = """
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT {id} AS node, {id} AS low FROM {all} UNION SELECT edge.b, reach.low FROM reach JOIN edge ON edge.a = reach.node WHERE reach.low < edge.b),
comp AS (SELECT node, min(low) AS low FROM reach GROUP BY node)"""

OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),""" + _COMPONENTS.format(id="doc_id", all="documents") + """
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id, d.doc_id = low AS kept FROM documents d JOIN comp ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),""" + _COMPONENTS.format(id="vec_id", all="embeddings") + """
SELECT e.vec_id, (SELECT count(*) FROM edge WHERE edge.a = e.vec_id) AS n_links, low AS component_id, e.vec_id = low AS kept FROM embeddings e JOIN comp ON node = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op2_decontaminate": OP2, "op4_pii": OP4, "op6_near_dup": OP6, "op7_secret_scan": OP7, "op9_vector_dup": OP9}
