"""Relations of ``issq.sources.derived`` as DuckDB common table expressions."""

CODE = "((({k})::BIGINT * 2654435761) >> 8) & 16777215"
EMB = """emb AS (
  SELECT vec_id AS read_id, CAST((vec_id * 7919) % 401 AS DOUBLE) AS x, CAST((vec_id * 104729) % 397 AS DOUBLE) AS y,
         CAST(label AS BIGINT) AS cell, 1 + vec_id % 5 AS cnt,
         list_transform(range(16), lambda c: list_transform(embedding[4 * c + 1 : 4 * c + 4], lambda v: CAST(v AS DOUBLE))) AS vals
  FROM embeddings)"""
CALL = "list_transform({v}, lambda w: ['G', 'T', 'A', 'C'][list_position(w, list_max(w))])"
CALLED = EMB + """, called AS (
  SELECT *, """ + CALL.format(v="vals") + """ AS bases, list_transform(vals, lambda w: sqrt(list_sum(list_transform(w, lambda e: e * e)))) AS norms FROM emb)"""
UNPACK = "array_to_string(list_transform(range(12), lambda i: substr('GTAC', CAST((({p} >> (2 * i)) & 3) AS INT) + 1, 1)), '')"
LIB = f"lib AS (SELECT p_partkey AS lib_id, 0 AS slot, {CODE.format(k='p_partkey')} AS packed FROM part)"
BC = f"""bc0 AS (SELECT l_orderkey AS entry, l_partkey AS ord, count(*) AS cnt FROM lineitem GROUP BY ALL),
bc AS (SELECT entry, ord, cnt, CASE WHEN (entry + ord) % 4 = 0 THEN xor({CODE.format(k='ord')}, 4194304) ELSE {CODE.format(k='ord')} END AS packed FROM bc0)"""
SMALL = f"""sr0 AS (SELECT CAST(s_nationkey AS BIGINT) AS entry, s_suppkey AS ord, 1 + s_suppkey % 4 AS cnt, {CODE.format(k='s_nationkey')} AS p FROM supplier),
sr1 AS (SELECT *, CASE WHEN ord % 2 = 0 THEN xor(p, 1) ELSE p END AS p1 FROM sr0),
sr2 AS (SELECT *, CASE WHEN ord % 3 = 0 THEN xor(p1, 1024) ELSE p1 END AS p2 FROM sr1),
sr AS (SELECT entry, ord, cnt, CASE WHEN ord % 5 = 0 THEN xor(p2, 4194304) ELSE p2 END AS packed FROM sr2),
sl AS (SELECT CAST(n_nationkey AS BIGINT) AS lib_id, 0 AS slot, {CODE.format(k='n_nationkey')} AS packed FROM nation),
pl AS (SELECT CAST(n_nationkey // 2 AS BIGINT) AS lib_id, n_nationkey % 2 AS slot, {CODE.format(k='n_nationkey')} AS packed FROM nation)"""
HAMMING = "bit_count((xor({a}, {b}) | (xor({a}, {b}) >> 1)) & 6148914691236517205)"
PIXELS = EMB + """, px AS (
  SELECT c AS cycle, k AS channel, read_id AS x, 0 AS y, vals[c + 1][k + 1] AS v
  FROM emb, (SELECT unnest(range(16)) AS c), (SELECT unnest(range(4)) AS k))"""
MASKS = """mk0 AS (SELECT o_orderkey % 128 AS x, o_orderkey // 128 AS y FROM orders),
mk AS (SELECT x, y,
  CASE WHEN x % 16 < 12 AND y % 16 < 12 THEN 1 + x // 16 + 8 * (y // 16) ELSE 0 END AS cell,
  CASE WHEN (x + 3) % 16 < 7 AND (y + 5) % 16 < 7 THEN 1 + (x + 3) // 16 + 9 * ((y + 5) // 16) ELSE 0 END AS nucleus FROM mk0)"""
EDGES = CALLED + """, e AS (
  SELECT a.read_id AS i, b.read_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS direct,
    list_sum(list_transform(range(1, 17), lambda c: CASE WHEN a.bases[c] <> b.bases[c]
      THEN a.norms[c] * b.norms[c] - list_sum(list_transform(range(1, 5), lambda k: a.vals[c][k] * b.vals[c][k])) ELSE 0 END)) AS vd,
    len(list_filter(range(1, 17), lambda c: a.bases[c] <> b.bases[c])) AS sd
  FROM called a JOIN called b ON a.read_id < b.read_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {cutoff})"""


def modes(relation: str, key: str, col: str, name: str) -> str:
    """The most frequent value by key, the smallest of ties, as a relation."""
    return f"""{name} AS (SELECT {key}, {col} FROM (SELECT {key}, {col}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {col}) AS r
  FROM {relation} GROUP BY {key}, {col}) WHERE r = 1)"""
