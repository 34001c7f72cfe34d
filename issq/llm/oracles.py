"""DuckDB SQL for the queries that SQL can express."""

OP3 = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), E' \t\n\x0b\x0c\r', '') AS n, length(coalesce(text, '')) AS c FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY c DESC, doc_id NULLS LAST)
"""

OP6 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path
  FROM h
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/'
  END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/7', 'example.net/de/8') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[^a-z0-9])(casino|bets|poker|jackpot|roulette|pills|viagra|cialis|porn|xxx|escort|camgirls|track|tracker|ads|adserver|adservice|doubleclick|phishing|malware|warez|keygen)([^a-z0-9]|$)') THEN 'block'
  WHEN regexp_matches(path, '/(ads|adverts)/') THEN 'block'
  WHEN regexp_matches(path, '(^|[^A-Za-z0-9])banner[-_][0-9]{2,4}x[0-9]{2,4}([^A-Za-z0-9]|$)') THEN 'block'
  WHEN regexp_matches(host, '(^|[^a-z0-9])payday-loans?([^a-z0-9]|$)') THEN 'block'
  WHEN regexp_matches(host, '(^|[^a-z0-9])online-pharmacy([^a-z0-9]|$)') THEN 'block'
  WHEN regexp_matches(host, '(^|[^a-z0-9])paypal-') THEN 'block'
  WHEN path LIKE '%/wp-login.php' OR path LIKE '%.exe' THEN 'block'
  WHEN regexp_matches(host, '^[0-9]{1,3}([.][0-9]{1,3}){3}(:[0-9]+)?$') THEN 'block'
  WHEN regexp_matches(host, '[a-z0-9](-[a-z0-9]+){4}') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op6_url_filter": OP6}
