"""DuckDB twin of the isolation forest: the same samples, trees and scores in recursive SQL."""

from __future__ import annotations

from .. import constants as K
from ..operators.iforest import EULER_GAMMA, PATH_UNITS, PRIME

FEATURE_COUNT = len(K.FEATURES)


def draw(x: str, k: str) -> str:
    """Twin of ``operators.iforest.draw``."""
    y = f"((({x}) % {PRIME}) * ((({k}) * 48271 + 11) % {PRIME} + 1) + 12345 + ({k})) % {PRIME}"
    return f"((xor({y}, ({y}) >> 15) * 16807 + ({k})) % {PRIME})"


def _pick(prefix: str, index: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {prefix}{i}" for i in range(FEATURE_COUNT))
    return f"CASE {index} {cases} END"


def _split(source: str) -> str:
    """Rows of ``source`` (with node, t, depth, size and the features' lo, hi) with the feature ``f`` (-1: a leaf) and threshold."""
    usable = "list_filter([" + ", ".join(f"CASE WHEN hi{i} > lo{i} THEN {i} END" for i in range(FEATURE_COUNT)) + "], lambda i: i IS NOT NULL)"
    first = f"({draw(f'{K.FOREST_SEED} * 1000003 + t', '1')} * 1024 + node)"
    chosen = (f"(SELECT *, CASE WHEN depth >= max_depth OR size <= 1 OR len(usable) = 0 THEN -1 "
              f"ELSE usable[1 + {draw('first_draw', '2')} % len(usable)] END AS f "
              f"FROM (SELECT *, {usable} AS usable, {first} AS first_draw FROM {source}))")
    low, high = _pick("lo", "f"), _pick("hi", "f")
    at = f"({low}) + (CAST({draw('first_draw', '3')} AS DOUBLE) / {PRIME}.0E0) * (({high}) - ({low}))"
    return f"(SELECT *, CASE WHEN f >= 0 THEN CASE WHEN {at} >= ({high}) THEN ({low}) ELSE {at} END END AS threshold FROM {chosen})"


def forest_ctes(rows: str, sample_hash, contamination: float = K.DEFAULT_CONTAMINATION) -> str:
    """CTE ``scored``: every row of ``rows`` with ``anomaly_score`` and ``is_anomaly``."""
    fs = ", ".join(f"f{i}" for i in range(FEATURE_COUNT))
    bounds = "min(f{0}) {1} AS lo{0}, max(f{0}) {1} AS hi{0}"
    over = ", ".join(bounds.format(i, "OVER w") for i in range(FEATURE_COUNT))
    grouped = ", ".join(bounds.format(i, "") for i in range(FEATURE_COUNT))
    values = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0E0) AS f{i}" for i, c in enumerate(K.FEATURES))
    leaf = (f"CASE WHEN size > 2 THEN 2.0E0 * (ln(CAST(size AS DOUBLE) - 1.0E0) + {EULER_GAMMA}E0) "
            f"- 2.0E0 * (CAST(size AS DOUBLE) - 1.0E0) / CAST(size AS DOUBLE) WHEN size = 2 THEN 1.0E0 ELSE 0.0E0 END")
    return f"""
, feat AS (SELECT transaction_id AS id, row_number() OVER (ORDER BY transaction_id) AS r,
                  {sample_hash('transaction_id', K.FOREST_SEED)} AS h, {values} FROM {rows}),
sizes AS (SELECT COUNT(*) AS n, least({K.FOREST_MAX_SAMPLES}, COUNT(*)) AS psi,
                 CAST(ceil(log2(greatest(least({K.FOREST_MAX_SAMPLES}, COUNT(*)), 2))) AS BIGINT) AS max_depth FROM feat),
trees AS (SELECT CAST(unnest(range({K.FOREST_TREES})) AS BIGINT) AS t),
grow AS (
  SELECT t, CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth, max_depth, {fs}
  FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {draw('h', 't')}, id) AS place FROM feat, trees) d, sizes
  WHERE place <= psi
  UNION ALL
  SELECT t, CASE WHEN {_pick('f', 'f')} <= threshold THEN 2 * node ELSE 2 * node + 1 END, depth + 1, max_depth, {fs}
  FROM {_split(f'(SELECT *, COUNT(*) OVER w AS size, {over} FROM grow WINDOW w AS (PARTITION BY t, node))')}
  WHERE f >= 0),
nodes AS (SELECT t, node, f, threshold, depth * {PATH_UNITS} + CAST(round(({leaf}) * {PATH_UNITS}.0E0) AS BIGINT) AS units
          FROM {_split(f'(SELECT t, node, depth, max_depth, COUNT(*) AS size, {grouped} FROM grow GROUP BY t, node, depth, max_depth)')}),
walk AS (
  SELECT r, t, CAST(1 AS BIGINT) AS node FROM feat, trees
  UNION ALL
  SELECT w.r, w.t, CASE WHEN {_pick('x.f', 'm.f')} <= m.threshold THEN 2 * w.node ELSE 2 * w.node + 1 END
  FROM walk w JOIN nodes m ON m.t = w.t AND m.node = w.node JOIN feat x ON x.r = w.r WHERE m.f >= 0),
paths AS (SELECT w.r, CAST(SUM(m.units) AS DOUBLE) / ({PATH_UNITS}.0E0 * {K.FOREST_TREES}.0E0) AS path
          FROM walk w JOIN nodes m ON m.t = w.t AND m.node = w.node WHERE m.f < 0 GROUP BY w.r),
scale AS (SELECT n, {leaf} AS c FROM (SELECT n, psi AS size FROM sizes)),
ss AS (SELECT x.id, CASE WHEN c = 0 THEN -0.5E0 ELSE -pow(2.0E0, -path / c) END AS s FROM paths p JOIN feat x ON x.r = p.r, scale),
ranked_ss AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS k FROM ss),
cut AS (SELECT pos - floor(pos) AS part, (SELECT s FROM ranked_ss WHERE k = floor(pos)) AS a,
               (SELECT s FROM ranked_ss WHERE k = least(floor(pos) + 1, n - 1)) AS b
        FROM (SELECT n, {contamination}E0 * (n - 1) AS pos FROM sizes)),
cut_off AS (SELECT CASE WHEN part >= 0.5E0 THEN b - (b - a) * (1 - part) ELSE a + (b - a) * part END AS off FROM cut),
scored AS (SELECT z.*, -(s - off) AS anomaly_score, (s - off) < 0 AS is_anomaly
           FROM {rows} z JOIN ss ON ss.id = z.transaction_id, cut_off)"""
