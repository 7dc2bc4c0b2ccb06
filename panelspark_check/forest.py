"""The isolation forest as DuckDB SQL: draws, depths and walks written out."""

_TREES, _SAMPLE, _SEED, _DEPTHS, _PRIME = 100, 256, 42, 8, 2147483647


def _hex(digits: str, start: int, n: int) -> str:
    return f"CAST('0x' || substr({digits}, {start}, {n}) AS BIGINT)"


def _length(size: str) -> str:
    return (
        f"CASE WHEN coalesce({size}, 0) <= 1 THEN 0.0 WHEN {size} = 2 THEN 1.0 "
        f"ELSE 2 * (ln({size} - 1) + 0.5772156649015329) - 2 * CAST({size} - 1 AS DOUBLE) / {size} END"
    )


def _depth(d: int) -> str:
    return f""", measured{d} AS (
  SELECT tree, x, node, count(*) OVER w AS n, md5('{_SEED}:' || tree || ':' || node) AS digits,
    [{', '.join(f'min(x[{j}]) OVER w' for j in (1, 2, 3, 4))}] AS low,
    [{', '.join(f'max(x[{j}]) OVER w' for j in (1, 2, 3, 4))}] AS high
  FROM grown{d} WINDOW w AS (PARTITION BY tree, node)
), chosen{d} AS (
  SELECT *, CASE WHEN n >= 2 AND len(able) > 0 AND {2**d} < (SELECT least({_SAMPLE}, count(*)) FROM h3)
    THEN able[1 + {_hex('digits', 1, 7)} % len(able)] END AS feature
  FROM (SELECT *, list_filter([1, 2, 3, 4], lambda j: high[j] > low[j]) AS able FROM measured{d}) q
), cut{d} AS (
  SELECT tree, x, node, feature,
    low[feature] + (high[feature] - low[feature]) * (CAST({_hex('digits', 8, 13)} AS DOUBLE) / 4503599627370496.0) AS cut
  FROM chosen{d}
), grown{d + 1} AS (
  SELECT tree, x, CASE WHEN feature IS NULL THEN node ELSE 2 * node + CAST(x[feature] > cut AS INT) END AS node FROM cut{d}
)"""


def _step(d: int) -> str:
    return f""", walk{d + 1} AS (
  SELECT w.id, w.x, w.tree, w.depth + CAST(s.feature IS NOT NULL AS INT) AS depth,
    CASE WHEN s.feature IS NULL THEN w.node ELSE 2 * w.node + CAST(w.x[s.feature] > s.cut AS INT) END AS node
  FROM walk{d} w LEFT JOIN splits s ON w.tree = s.tree AND w.node = s.node
)"""


#: To follow the common table expressions; ends with ``forest`` (id, if_score, if_anomaly) and
#: ``both_models``, the scored rows with both models.
FOREST = f"""
, points AS (
  SELECT id, country, heading, year, [f1, f2, f3, f4] AS x,
    {_hex(f"md5('{_SEED}|' || country || '|' || heading || '|' || year)", 1, 8)} % {_PRIME} AS u FROM h3
), plants AS (
  SELECT t AS tree, 1 + {_hex('d', 1, 8)} % {_PRIME - 1} AS a, {_hex('d', 9, 8)} % {_PRIME} AS b
  FROM (SELECT t, md5('{_SEED}:' || t) AS d FROM range({_TREES}) r(t)) q
), grown0 AS (
  SELECT tree, x, 1 AS node FROM (
    SELECT tree, x, row_number() OVER (PARTITION BY tree ORDER BY (a * u + b) % {_PRIME}, country, heading, year) AS place
    FROM points, plants) q
  WHERE place <= {_SAMPLE}
){''.join(_depth(d) for d in range(_DEPTHS))}
, splits AS (
  {' UNION '.join(f'SELECT tree, node, feature, cut FROM cut{d} WHERE feature IS NOT NULL' for d in range(_DEPTHS))}
), leaves AS (
  SELECT tree, node, count(*) AS n FROM grown{_DEPTHS} GROUP BY ALL
), walk0 AS (
  SELECT id, x, tree, 0 AS depth, 1 AS node FROM points, plants
){''.join(_step(d) for d in range(_DEPTHS))}
, paths AS (
  SELECT id, sum(CAST(round((depth + {_length('l.n')}) * 1e9) AS BIGINT)) AS units
  FROM walk{_DEPTHS} w LEFT JOIN leaves l ON w.tree = l.tree AND w.node = l.node GROUP BY id
), forest_scores AS (
  SELECT id, -pow(2, -(CAST(units AS DOUBLE) / 1e9 / {_TREES}) / (SELECT {_length('n')} FROM (SELECT least({_SAMPLE}, count(*)) AS n FROM h3) q)) AS score
  FROM paths
), forest AS (
  SELECT id, round(score, 6) AS if_score,
    CASE WHEN score < (SELECT quantile_cont(score, 0.05) FROM forest_scores) THEN 1 ELSE 0 END AS if_anomaly
  FROM forest_scores
), both_models AS (
  SELECT h3.* EXCLUDE (id, f1, f2, f3, f4), if_score, if_anomaly, round(lof.score, 6) AS lof_score,
    CASE WHEN lof.score < (SELECT quantile_cont(score, 0.05) FROM lof) THEN 1 ELSE 0 END AS lof_anomaly
  FROM h3 LEFT JOIN forest ON h3.id = forest.id LEFT JOIN lof ON h3.id = lof.id
)
"""
