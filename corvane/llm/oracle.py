"""DuckDB twins of the operators that SQL can express."""

from .url_filter import FLOOD, RULES

_HOST = r"translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"


def _rules() -> tuple[str, str]:
    name, verdict = "", ""
    for act, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN "
        name += f"{fits}'{host}{path}' "
        verdict += f"{fits}'{act}' "
    return f"CASE {name}END", f"CASE {verdict}WHEN host <> '' AND count(*) OVER (PARTITION BY host) >= {FLOOD} THEN 'block' ELSE 'allow' END"


OP9 = f"""
SELECT page_id, host, path, {_rules()[0]} AS rule, {_rules()[1]} AS verdict
FROM (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (SELECT sum(source_size) FROM s) AS total FROM s),
g AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
l AS (SELECT max(level) FILTER (level * w <= cap) AS level FROM g),
t AS (SELECT g.source, source_size, total, CASE WHEN l.level IS NULL OR l.level * w > cap THEN cap ELSE l.level * w END AS target FROM g, l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.total, sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT size, (sent - size / 2.0 + e * source_size) / target AS finish, total FROM q, (VALUES (0), (1), (2)) AS e(e) WHERE size > 0 AND target > 0),
c AS (SELECT min(finish) AS cut FROM (SELECT finish, total, sum(size) OVER (ORDER BY finish) AS upto FROM r) WHERE upto >= total)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(CASE WHEN size > 0 AND target > 0 THEN size * greatest(0, least(3, floor((c.cut * target - (sent - size / 2.0)) / source_size) + 1)) ELSE 0 END AS BIGINT) AS taken
FROM q, c
"""
