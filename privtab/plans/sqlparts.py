"""SQL fragments shared by the DuckDB oracles."""

from __future__ import annotations

SEEDS = [42, 43, 44, 45, 46]
K_VALUES = [2, 5, 10, 20, 50, 100]


def md5_of(seed: str, key: str) -> str:
    return f"md5(concat_ws(':', CAST({seed} AS VARCHAR), CAST({key} AS VARCHAR)))"


def seeds_sql(seeds=SEEDS) -> str:
    return f"(SELECT unnest([{', '.join(str(s) for s in seeds)}]) AS seed)"


def split_ctes(src: str, key: str, target: str, test_size: float = 0.2,
               seeds=SEEDS, name: str = "split") -> str:
    """CTEs ending in ``<name>``: rows of ``src`` x seeds with ``is_test``
    (plain window form: row_number per (seed, class) in md5 order)."""
    return f"""
{name}_x AS (SELECT s.seed, t.*, {md5_of('s.seed', 't.' + key)} AS _h
             FROM {src} t CROSS JOIN {seeds_sql(seeds)} s),
{name}_cnt AS (SELECT seed, {target} AS _cls, count(*) AS n_c FROM {name}_x GROUP BY ALL),
{name}_tot AS (SELECT seed, sum(n_c) AS n,
                      CAST(ceil(CAST({test_size} AS DOUBLE) * sum(n_c)) AS BIGINT) AS nt
               FROM {name}_cnt GROUP BY seed),
{name}_q0 AS (SELECT c.seed, _cls, (nt * n_c) // n AS q, (nt * n_c) % n AS rem, nt
              FROM {name}_cnt c JOIN {name}_tot USING (seed)),
{name}_q1 AS (SELECT *, nt - sum(q) OVER (PARTITION BY seed) AS short,
                     row_number() OVER (PARTITION BY seed ORDER BY rem DESC, _cls ASC) AS rr
              FROM {name}_q0),
{name}_quota AS (SELECT seed, _cls, q + CASE WHEN rr <= short THEN 1 ELSE 0 END AS quota
                 FROM {name}_q1),
{name}_r AS (SELECT x.*, row_number() OVER (PARTITION BY seed, {target} ORDER BY _h, {key}) AS _rn
             FROM {name}_x x),
{name} AS (SELECT r.* EXCLUDE (_rn, _h), _rn <= quota AS is_test
           FROM {name}_r r JOIN {name}_quota qq ON r.seed = qq.seed AND r.{target} = qq._cls)"""


def sweep_sql(sizes_sql: str, by: str = "", ks=K_VALUES, with_pos: bool = False) -> str:
    """Oracle for a k sweep over a size table with columns (by.., n,
    unclassed[, n_pos])."""
    sel_by = f"{by}, " if by else ""
    pos_agg = (",\n         coalesce(sum(CASE WHEN NOT unclassed AND n >= k THEN n_pos END), 0)"
               " AS pos_kept") if with_pos else ""
    pos_sel = ",\n       CAST(pos_kept AS BIGINT) AS pos_kept" if with_pos else ""
    return f"""
WITH sizes AS ({sizes_sql}),
agg AS (
  SELECT {sel_by}k, sum(n) AS total,
         coalesce(sum(CASE WHEN NOT unclassed AND n >= k THEN n END), 0) AS used,
         count(CASE WHEN NOT unclassed THEN 1 END) AS classes_before,
         count(CASE WHEN NOT unclassed AND n >= k THEN 1 END) AS classes_after,
         coalesce(min(CASE WHEN NOT unclassed AND n >= k THEN n END), 0) AS min_class_size{pos_agg}
  FROM sizes CROSS JOIN (SELECT unnest([{', '.join(str(k) for k in ks)}]) AS k) ks
  GROUP BY {sel_by}k)
SELECT {sel_by}CAST(k AS INTEGER) AS k,
       CAST(used AS BIGINT) AS train_rows_used,
       CAST(total - used AS BIGINT) AS rows_suppressed,
       CASE WHEN total = 0 THEN 0.0
            ELSE CAST((20000 * (total - used) + total) // (2 * total) AS DOUBLE) / 100 END
         AS suppression_rate,
       CAST(classes_before AS BIGINT) AS classes_before,
       CAST(classes_after AS BIGINT) AS classes_after,
       CAST(min_class_size AS BIGINT) AS min_class_size{pos_sel}
FROM agg"""


def band_sql(expr: str, edges) -> str:
    e = [f"CAST({float(x)!r} AS DOUBLE)" for x in edges]
    parts = [f"WHEN {expr} >= {e[0]} AND {expr} <= {e[1]} THEN 0"]
    for i in range(1, len(e) - 1):
        parts.append(f"WHEN {expr} > {e[i]} AND {expr} <= {e[i + 1]} THEN {i}")
    return f"CAST(CASE {' '.join(parts)} END AS INTEGER)"


def rnd(expr: str, places: int) -> str:
    """SQL twin of ``functions.exprs.round_fixed``."""
    p = float(10 ** places)
    return f"(CAST(floor(CAST({expr} AS DOUBLE) * {p!r} + 0.5) AS DOUBLE) / {p!r})"
