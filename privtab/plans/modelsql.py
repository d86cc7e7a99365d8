"""DuckDB oracles of the model queries.

Newton's method as a recursive CTE: one aggregate of gradient and Hessian sums
per group and step, the step itself by Gaussian elimination in columns.
Forests level by level: histograms of all nodes, the best cut of each by
windows, cells routed to the children.
"""

from __future__ import annotations

from collections.abc import Sequence

from privtab.operators import anonymity as K
from privtab.operators import dp as D
from privtab.operators import forest as FO
from privtab.plans.sqlparts import K_VALUES, SEEDS, md5_of, rnd, split_ctes, sweep_sql

STEPS = 25

_UNIT = ("CAST(('0x' || substr(" + md5_of("'99'", "o_orderkey") + ", 1, 13))::BIGINT AS DOUBLE) "
         f"/ {float(16 ** 13)!r}")

_METRICS = """cells AS (SELECT seed, model, setting,
                 count(CASE WHEN actual = 0 AND predicted = 0 THEN 1 END) AS tn,
                 count(CASE WHEN actual = 0 AND predicted = 1 THEN 1 END) AS fp,
                 count(CASE WHEN actual = 1 AND predicted = 0 THEN 1 END) AS fn,
                 count(CASE WHEN actual = 1 AND predicted = 1 THEN 1 END) AS tp
          FROM preds GROUP BY ALL)
SELECT seed, model, setting,
   coalesce(CAST(tp + tn AS DOUBLE) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0.0) AS accuracy,
   coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1,
   coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
   coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall
FROM cells"""


_FAMILY = "SELECT seed, model, setting, actual, predicted FROM "


def _dbl(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _scaled(col: str, src: str) -> str:
    mn, mx = f"(SELECT min({col}) FROM {src})", f"(SELECT max({col}) FROM {src})"
    return (f"CASE WHEN {col} IS NOT NULL THEN coalesce(({col} - {mn}) / nullif({mx} - {mn}, 0), 0.0) "
            f"END AS {col}")


def _orders(feats: Sequence[str], extra: str = "") -> str:
    """CTEs up to ``split``: scaled orders with the derived target, per seed;
    ``extra``: further columns of ``orders``."""
    names = "".join(f", {e.split(' AS ')[-1]}" for e in extra.split("; ") if e)
    more = "".join(f", {e}" for e in extra.split("; ") if e)
    return f"""WITH RECURSIVE
raw AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price_s,
               TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prio_s,
               CAST(month(o_orderdate) AS DOUBLE) AS month_s{more} FROM orders),
sc AS (SELECT o_orderkey, {', '.join(_scaled(c, 'raw') for c in feats)}{names} FROM raw),
lab AS (SELECT *, CASE WHEN price_s + {_dbl(0.4)} * ({_UNIT} - {_dbl(0.5)}) > {_dbl(0.55)}
                       THEN 1 ELSE 0 END AS target FROM sc),
{split_ctes('lab', 'o_orderkey', 'target')},
tr AS MATERIALIZED (SELECT * FROM split WHERE NOT is_test),
te AS MATERIALIZED (SELECT * FROM split WHERE is_test)"""


def _sites(settings) -> str:
    """Train rows per setting with their site, and their class weight there."""
    return f"""st0 AS (SELECT tr.*, n_sites, ntile(n_sites) OVER (PARTITION BY seed, n_sites
                ORDER BY {md5_of('seed', 'o_orderkey')}, o_orderkey) - 1 AS silo
         FROM tr CROSS JOIN (SELECT unnest({[p for p, _ in settings]}) AS n_sites))"""


def _weights(src: str, name: str, by: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT {src}.*, n / (kc * n_c) AS w FROM {src} JOIN (
  SELECT *, CAST(sum(n_c) OVER (PARTITION BY {by}) AS DOUBLE) AS n, count(*) OVER (PARTITION BY {by}) AS kc
  FROM (SELECT {by}, target, count(*) AS n_c FROM {src} GROUP BY ALL)) USING ({by}, target))"""


def _step(src: str, keys: str, p: int) -> str:
    """SELECT of ``keys`` and s0.. (the solution of h s = g) for every row of ``src``."""
    sql = src
    for i in range(p - 1):
        cols = [f"h{j}_{k}" for j in range(i + 1) for k in range(j, p)] + [f"g{j}" for j in range(i + 1)]
        for j in range(i + 1, p):
            f = f"h{i}_{j} / h{i}_{i}"
            cols += [f"h{j}_{k} - {f} * h{i}_{k} AS h{j}_{k}" for k in range(j, p)]
            cols.append(f"g{j} - {f} * g{i} AS g{j}")
        sql = f"(SELECT {keys}, {', '.join(cols)} FROM {sql})"
    for i in reversed(range(p)):
        rest = "".join(f" - h{i}_{k} * s{k}" for k in range(i + 1, p))
        sql = f"(SELECT *, (g{i}{rest}) / h{i}_{i} AS s{i} FROM {sql})"
    return f"(SELECT {keys}, {', '.join(f's{i}' for i in range(p))} FROM {sql})"


def _sums(x: Sequence[str], penalty: Sequence[str], linear: Sequence[str] | None = None) -> str:
    """Gradient and Hessian sums of rows with x, y, w and probability pr."""
    p = len(x)
    parts = [f"sum(w * (pr - y) * {x[j]}) + {penalty[j]} * b{j}" + (f" + {linear[j]}" if linear else "")
             + f" AS g{j}" for j in range(p)]
    parts += [f"sum(w * pr * (1 - pr) * {x[j]} * {x[k]})" + (f" + {penalty[j]}" if j == k else "")
              + f" AS h{j}_{k}" for j in range(p) for k in range(j, p)]
    return ", ".join(parts)


def _score(x: Sequence[str], table: str = "") -> str:
    return " + ".join(f"{c} * {table}b{j}" for j, c in enumerate(x))


def _newton(name: str, src: str, group: str, x: Sequence[str], penalty: Sequence[str],
            linear: Sequence[str] | None = None) -> str:
    """CTEs ending in ``name`` (group, b0..): fits of ``src`` (group, x.., y, w)."""
    p = len(x)
    bs = ", ".join(f"b{j}" for j in range(p))
    rows = (f"(SELECT {src}.*, it, {bs}, 1.0 / (1.0 + exp(-({_score(x)}))) AS pr "
            f"FROM {name}_it JOIN {src} USING ({group}) WHERE it < {STEPS})")
    agg = f"(SELECT {group}, it, {bs}, {_sums(x, penalty, linear)} FROM {rows} GROUP BY {group}, it, {bs})"
    new = ", ".join(f"b{j} - s{j}" for j in range(p))
    return f"""{name}_it AS (
  SELECT {group}, 0 AS it, {', '.join(f'CAST(0 AS DOUBLE) AS b{j}' for j in range(p))}
  FROM (SELECT DISTINCT {group} FROM {src})
  UNION ALL SELECT {group}, it + 1, {new} FROM {_step(agg, f'{group}, it, {bs}', p)}),
{name} AS (SELECT {group}, {bs} FROM {name}_it WHERE it = {STEPS})"""


def _site_fits(settings, feats: Sequence[str]) -> tuple[str, list[str]]:
    """CTEs ending in ``fit`` (site, b0..) over ``fx``, with the baseline as site ``seed:0:0``."""
    x = [*feats, "one"]
    cols = ", ".join(feats)
    return f"""{_sites(settings)},
al AS (SELECT printf('%d:%d:%d', seed, n_sites, silo) AS site, seed, n_sites, silo, {cols}, target FROM st0
       UNION ALL SELECT printf('%d:0:0', seed), seed, 0, 0, {cols}, target FROM tr),
{_weights('al', 'aw', 'site')},
fx AS MATERIALIZED (SELECT *, CAST(1 AS DOUBLE) AS one, CAST(target AS DOUBLE) AS y FROM aw),
{_newton('fit', 'fx', 'site', x, ['1.0'] * len(feats) + ['0.0'])}""", x


def silo_lr(settings, feats: Sequence[str]) -> str:
    ctes, _ = _site_fits(settings, feats)
    names = [*feats, "intercept"]
    rows = " UNION ALL ".join(f"SELECT site, '{n}' AS feature, b{j} AS coef FROM fit" for j, n in enumerate(names))
    part = [f"CAST(split_part(site, ':', {i}) AS INTEGER)" for i in (1, 2, 3)]
    return f"""{_orders(feats)}, {ctes}
SELECT {part[0]} AS seed, {part[1]} AS n_sites, {part[2]} AS silo, feature, {rnd('coef', 6)} AS coef
FROM ({rows}) WHERE {part[1]} > 0"""


def _fl_names(settings) -> str:
    return "CASE n_sites " + " ".join(f"WHEN {p} THEN 'FL ({p} clients, {r} rounds)'" for p, r in settings) + " END"


def _fl_forest(settings, feats: Sequence[str], trees: int, bins: int) -> str:
    """CTEs ending in ``flp`` (run rows) over the sites ``st0`` and test rows ``te``."""
    per = "CASE n_sites " + " ".join(f"WHEN {p} THEN {r * trees}" for p, r in settings) + " END"
    cols = ", ".join(feats)
    whole = "CASE n_sites " + " ".join(f"WHEN {p} THEN {p * r * trees}" for p, r in settings) + " END"
    site = "printf('%d:%d:%d', seed, n_sites, silo)"
    return f"""fltr AS (SELECT {site} AS grp, seed, {per} AS trees, o_orderkey AS key, target AS y, {cols} FROM st0),
flte AS (SELECT {site} AS grp, seed, {per} AS trees, n_sites, o_orderkey, target, {cols}
         FROM te JOIN (SELECT DISTINCT seed, n_sites, silo FROM st0) USING (seed)),
{_forest('flf', 'fltr', 'flte', feats, 'true', bins)},
flb AS (SELECT DISTINCT seed, n_sites, o_orderkey, target, grp, {_binned(feats, bins)} FROM flte),
flp AS (SELECT seed, 'Federated Random Forest' AS model, {_fl_names(settings)} AS setting, target AS actual,
               CAST(2 * sum(votes) >= CAST({whole} AS BIGINT) * {FO.UNIT} AS INTEGER) AS predicted
        FROM flb JOIN flf USING (grp, {_bs(feats)}) GROUP BY seed, n_sites, o_orderkey, target)"""


def _baseline(name: str, feats: Sequence[str], balanced: str, trees: int) -> str:
    """CTEs ending in ``name``: run rows of a forest per seed over tr and te."""
    cols = ", ".join(feats)
    return f"""{name}tr AS (SELECT seed AS grp, seed, {trees} AS trees, o_orderkey AS key, target AS y, {cols} FROM tr),
{name}te AS (SELECT seed AS grp, seed, {trees} AS trees, target, {cols} FROM te),
{_forest(name + 'f', name + 'tr', name + 'te', feats, balanced)},
{name} AS (SELECT seed, 'Random Forest' AS model, 'Baseline (No Privacy)' AS setting, target AS actual,
                  CAST(2 * votes >= {trees * FO.UNIT} AS INTEGER) AS predicted
           FROM (SELECT *, {_binned(feats, FO.BINS)} FROM {name}te) JOIN {name}f USING (grp, {_bs(feats)}))"""


def silo_rf(settings, feats: Sequence[str], trees: int, bins: int) -> str:
    return f"""{_orders(feats)}, {_sites(settings)},
{_fl_forest(settings, feats, trees, bins)},
preds AS (SELECT * FROM flp),
{_METRICS}"""


def silo_utility(settings, feats: Sequence[str], trees: int, round_trees: int, bins: int) -> str:
    ctes, x = _site_fits(settings, feats)
    names = "CASE WHEN n_sites = 0 THEN 'Baseline (No Privacy)' ELSE " + _fl_names(settings) + " END"
    return f"""{_orders(feats)}, {ctes},
sm AS (SELECT fit.*, CAST(split_part(site, ':', 1) AS INTEGER) AS seed,
              CAST(split_part(site, ':', 2) AS INTEGER) AS n_sites FROM fit),
pr AS (SELECT seed, n_sites, o_orderkey, target, avg(1.0 / (1.0 + exp(-({_score(x)})))) AS prob
       FROM (SELECT *, CAST(1 AS DOUBLE) AS one FROM te) JOIN sm USING (seed) GROUP BY ALL),
{_baseline('rfb', feats, 'true', trees)},
{_fl_forest(settings, feats, round_trees, bins)},
preds AS (SELECT seed, CASE WHEN n_sites = 0 THEN 'Logistic Regression'
                            ELSE 'Federated Logistic Regression' END AS model,
                 {names} AS setting, target AS actual, CAST(prob >= 0.5 AS INTEGER) AS predicted FROM pr
          UNION ALL {_FAMILY} rfb UNION ALL {_FAMILY} flp),
{_METRICS}"""


def fed_avg(settings, feats: Sequence[str]) -> str:
    x = [*feats, "one"]
    p = len(x)
    bs = ", ".join(f"b{j}" for j in range(p))
    rounds = "CASE n_sites " + " ".join(f"WHEN {n} THEN {r}" for n, r in settings) + " END"
    rows = (f"(SELECT fx.*, it, {bs}, 1.0 / (1.0 + exp(-({_score(x)}))) AS pr "
            f"FROM fa JOIN fx USING (seed, n_sites) WHERE it < {rounds})")
    keys = f"seed, n_sites, silo, it, {bs}"
    agg = (f"(SELECT {keys}, count(*) AS n, {_sums(x, ['1.0'] * len(feats) + ['0.0'])} "
           f"FROM {rows} GROUP BY {keys})")
    avg = ", ".join(f"sum(n * (b{j} - s{j})) / sum(n)" for j in range(p))
    names = "CASE n_sites " + " ".join(f"WHEN {n} THEN 'FL ({n} clients, {r} rounds)'" for n, r in settings) + " END"
    return f"""{_orders(feats)}, {_sites(settings)},
{_weights('st0', 'aw', 'seed, n_sites, silo')},
fx AS MATERIALIZED (SELECT *, CAST(1 AS DOUBLE) AS one, CAST(target AS DOUBLE) AS y FROM aw),
fa AS (SELECT seed, n_sites, 0 AS it, {', '.join(f'CAST(0 AS DOUBLE) AS b{j}' for j in range(p))}
       FROM (SELECT DISTINCT seed, n_sites FROM fx)
       UNION ALL SELECT seed, n_sites, it + 1, {avg} FROM {_step(agg, keys + ', n', p)}
       GROUP BY seed, n_sites, it),
preds AS (SELECT seed, 'FedAvg Logistic Regression' AS model, {names} AS setting, target AS actual,
                 CAST(1.0 / (1.0 + exp(-({_score(x)}))) >= 0.5 AS INTEGER) AS predicted
          FROM (SELECT *, CAST(1 AS DOUBLE) AS one FROM te) JOIN fa USING (seed) WHERE it = {rounds}),
{_METRICS}"""


DECLARED = "_d"


def _declared(bounds) -> str:
    """Declared columns over ``orders`` for ``_orders(extra=...)``."""
    src = {"o_totalprice": "o_totalprice", "prio": "TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)",
           "o_month": "month(o_orderdate)"}
    return "; ".join(f"least(greatest((CAST({src[c]} AS DOUBLE) - {_dbl(low)}) / {_dbl(high - low)}, 0.0), 1.0) AS {c}{DECLARED}"
                     for c, (low, high) in bounds.items())


def _dp_lr_ctes(epsilons, feats: Sequence[str], seeds=SEEDS) -> str:
    """The noise of each (seed, ε) is a literal; with λ = 1 / n neither the
    noise nor n times the extra ridge depends on the number of rows."""
    d = len(feats) + 1
    vals = []
    for s in seeds:
        for i, e in enumerate(epsilons):
            b, delta = D.perturbation_terms(e, 1, d, s * 1000 + i)
            vals.append(f"({s}, 'DP e={e}', {_dbl(1.0 + delta)}, {', '.join(_dbl(v) for v in b)})")
    lin = [f"l{j}" for j in range(d)]
    x = [f"x{j}" for j in range(d)]
    norm = " + ".join([f"{c} * {c}" for c in feats] + ["1.0"])
    clipped = ", ".join(f"{c} / greatest(1.0, sqrt({norm})) AS x{j}"
                        for j, c in enumerate([*feats, "CAST(1 AS DOUBLE)"]))
    return f"""noise(seed, setting, ridge, {', '.join(lin)}) AS (VALUES {', '.join(vals)}),
dpx AS MATERIALIZED (SELECT printf('%d/%s', seed, setting) AS grp, ridge, {', '.join(lin)}, {clipped},
                           CAST(target AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w
                    FROM tr JOIN noise USING (seed)),
{_newton('dpfit', 'dpx', 'grp', x, ['max(ridge)'] * d, [f'max({c})' for c in lin])},
dplr AS (SELECT seed, 'DP Logistic Regression' AS model, split_part(grp, '/', 2) AS setting,
                 target AS actual, CAST({_score([*feats, '1.0'])} >= 0 AS INTEGER) AS predicted
          FROM te JOIN dpfit ON te.seed = CAST(split_part(grp, '/', 1) AS INTEGER))"""


def dp_lr(epsilons, feats, bounds, dp_feats) -> str:
    return f"""{_orders(feats, _declared(bounds))},
{_dp_lr_ctes(epsilons, dp_feats)},
preds AS (SELECT * FROM dplr),
{_METRICS}"""


def _dp_forest_ctes(epsilons, feats: Sequence[str], trees: int, depth: int, noise_seed: int) -> str:
    """CTEs ending in ``dprf`` (run rows): trees by hash, leaves walked level by level."""
    inner, d = 2 ** depth - 1, len(feats)
    x = "[" + ", ".join(feats) + "]"

    def walked(src: str, name: str) -> str:
        ctes, prev = [], src
        for i in range(depth):
            cols = "* EXCLUDE (n), " if i else "*, "
            now = "2 * n" if i else "0"
            at = "n" if i else "0"
            ctes.append(f"{name}{i} AS (SELECT {cols}{now} + 1 + CASE WHEN x[tf[{at} + 1] + 1] > tt[{at} + 1] THEN 1 ELSE 0 END AS n FROM {prev})")
            prev = f"{name}{i}"
        return ", ".join(ctes)

    eps = ", ".join(f"({i}, {_dbl(e)}, 'DP e={e}')" for i, e in enumerate(epsilons))

    def gumbel(k):
        md5 = f"md5(concat_ws(':', '{noise_seed}', CAST(seed AS VARCHAR), CAST(e AS VARCHAR), CAST(tree AS VARCHAR), CAST(leaf AS VARCHAR), '{k}'))"
        unit = f"((CAST(('0x' || substr({md5}, 1, 13))::BIGINT AS DOUBLE) + 0.5) / {float(16 ** 13)!r})"
        return f"(-ln(-ln({unit})))"

    return f"""dtr AS MATERIALIZED (SELECT seed, tree, [{_draw('seed', 'tree', 'k * 2')} % {d} for k in range({inner})] AS tf,
             [CAST({_draw('seed', 'tree', 'k * 2 + 1')} AS DOUBLE) / {float(FO.PRIME)!r} for k in range({inner})] AS tt
             FROM (SELECT unnest({list(SEEDS)}) AS seed) CROSS JOIN (SELECT unnest(range({trees})) AS tree)),
dc AS (SELECT tr.seed, tree, {x} AS x, target, tf, tt FROM (SELECT *, (('0x' || substr({md5_of('seed', 'o_orderkey')}, 1, 8))::BIGINT) % {trees} AS tree FROM tr)
       tr JOIN dtr USING (seed, tree)),
{walked('dc', 'dw')},
dn AS (SELECT seed, tree, n - {inner} AS leaf, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1
       FROM dw{depth - 1} GROUP BY ALL),
dg AS (SELECT seed, e, eps, setting, tree, leaf, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1
       FROM (SELECT seed, tree, unnest(range({2 ** depth})) AS leaf FROM dtr) LEFT JOIN dn USING (seed, tree, leaf)
       CROSS JOIN (VALUES {eps}) v(e, eps, setting)),
dl AS MATERIALIZED (SELECT seed, setting, tree, leaf, CAST((eps * n1 / 2.0 + {gumbel(1)}) > (eps * n0 / 2.0 + {gumbel(0)}) AS INTEGER) AS label FROM dg),
dt AS (SELECT seed, o_orderkey, target, tree, {x} AS x, tf, tt FROM te JOIN dtr USING (seed)),
{walked('dt', 'dv')},
dprf AS (SELECT dv{depth - 1}.seed, 'DP Random Forest' AS model, setting, target AS actual, CAST(sum(label) / {float(trees)} >= 0.5 AS INTEGER) AS predicted
         FROM dv{depth - 1} JOIN dl ON dl.seed = dv{depth - 1}.seed AND dl.tree = dv{depth - 1}.tree AND dl.leaf = n - {inner}
         GROUP BY dv{depth - 1}.seed, setting, o_orderkey, target)"""


def dp_forest(epsilons, feats, bounds, dp_feats, trees: int, depth: int, noise_seed: int) -> str:
    return f"""{_orders(feats, _declared(bounds))},
{_dp_forest_ctes(epsilons, dp_feats, trees, depth, noise_seed)},
preds AS (SELECT * FROM dprf),
{_METRICS}"""


def dp_utility(epsilons, feats, bounds, dp_feats, trees: int, depth: int, noise_seed: int) -> str:
    x = [*feats, "one"]
    head, tail = _METRICS.split("SELECT seed, model, setting,\n   coalesce", 1)
    stats = ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in ("accuracy", "f1", "precision", "recall"))
    return f"""{_orders(feats, _declared(bounds))},
{_dp_lr_ctes(epsilons, dp_feats)},
{_dp_forest_ctes(epsilons, dp_feats, trees, depth, noise_seed)},
{_baseline('rfb', feats, 'false', trees)},
bx AS MATERIALIZED (SELECT *, CAST(1 AS DOUBLE) AS one, CAST(target AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w FROM tr),
{_newton('bfit', 'bx', 'seed', x, ['1.0'] * len(feats) + ['0.0'])},
preds AS ({_FAMILY} dplr UNION ALL {_FAMILY} dprf UNION ALL {_FAMILY} rfb
  UNION ALL SELECT seed, 'Logistic Regression', 'Baseline (No Privacy)', target, CAST(1.0 / (1.0 + exp(-({_score(x)}))) >= 0.5 AS INTEGER)
            FROM (SELECT *, CAST(1 AS DOUBLE) AS one FROM te) JOIN bfit USING (seed)),
{head}, runs AS (SELECT seed, model, setting,
   coalesce{tail})
SELECT model, setting, {stats} FROM runs GROUP BY model, setting"""


# ---- forests ------------------------------------------------------------------------------------------


def _draw(seed: str, a: str, b: str) -> str:
    """SQL twin of ``forest.draw``."""
    p = FO.PRIME
    x = f"((CAST({seed} AS BIGINT) * 7919 + CAST({a} AS BIGINT) * 104729 + CAST({b} AS BIGINT) * 1299709 + 12345) % {p})"
    x = f"(({x} * {x} + 48271) % {p})"
    return f"(({x} * {x} + 16807) % {p})"


def _bs(feats: Sequence[str]) -> str:
    return ", ".join(f"b{j}" for j in range(len(feats)))


def _binned(feats: Sequence[str], bins: int) -> str:
    return ", ".join(f"CAST(coalesce(least(greatest(floor({c} * {bins}), 0), {bins - 1}), 0) AS INTEGER) AS b{j}"
                     for j, c in enumerate(feats))


def _forest(n: str, train: str, asked: str, feats: Sequence[str], balanced: str, bins: int = FO.BINS,
            depth: int = FO.DEPTH) -> str:
    """CTEs ending in ``n`` (grp, b0.., votes).  ``train`` has grp, seed, trees,
    key, y and the features, ``asked`` grp, seed, trees and the features;
    ``balanced``: condition on grp."""
    d, bs = len(feats), _bs(feats)
    bucket = "(('0x' || substr(" + md5_of("seed", "key") + f", 15, 2))::BIGINT) % {FO.BUCKETS}"
    drawn = f"{list(FO.DRAWS)}[({_draw('seed', 'tree', 'bucket')} // 1024) % 16 + 1]"

    def weight(k):
        return (f"CASE WHEN NOT ({balanced}) THEN 1.0 WHEN t{k} = 0 THEN 0.0 ELSE CAST(t0 + t1 AS DOUBLE) / "
                f"CAST(((t0 > 0)::INTEGER + (t1 > 0)::INTEGER) * t{k} AS DOUBLE) END AS w{k}")

    ctes = [f"""{n}_c AS MATERIALIZED (SELECT grp, seed, trees, {bs}, bucket, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1
            FROM (SELECT grp, seed, trees, y, {_binned(feats, bins)}, {bucket} AS bucket FROM {train}) GROUP BY ALL)""",
            f"""{n}_w AS MATERIALIZED (SELECT grp, {weight(0)}, {weight(1)}
            FROM (SELECT grp, sum(n0) AS t0, sum(n1) AS t1 FROM {n}_c GROUP BY grp))""",
            f"""{n}_l0 AS MATERIALIZED (SELECT grp, seed, tree, CAST(1 AS BIGINT) AS node, {bs}, CAST(sum(c0) AS BIGINT) AS c0,
            CAST(sum(c1) AS BIGINT) AS c1, max(asked) AS asked FROM (
              SELECT grp, seed, tree, {bs}, w * n0 AS c0, w * n1 AS c1, 0 AS asked
              FROM (SELECT *, {drawn} AS w FROM (SELECT *, unnest(range(trees)) AS tree FROM {n}_c)) WHERE w > 0
              UNION ALL SELECT grp, seed, unnest(range(trees)) AS tree, {bs}, 0, 0, 1
              FROM (SELECT DISTINCT grp, seed, trees, {_binned(feats, bins)} FROM {asked}))
            GROUP BY grp, seed, tree, {bs})"""]
    ends = []
    for i in range(depth + 1):
        level, split = f"{n}_l{i}", f"{n}_s{i}"
        ctes.append(f"{n}_t{i} AS (SELECT grp, tree, node, CAST(sum(c0) AS BIGINT) AS t0, CAST(sum(c1) AS BIGINT) AS t1 "
                    f"FROM {level} GROUP BY grp, tree, node)")
        rest = ""
        if i < depth:
            of = f"PARTITION BY grp, tree, node, f"
            l0, l1, r0, r1 = (f"{x} * w{k}" for x, k in (("c0s", 0), ("c1s", 1), ("(t0 - c0s)", 0), ("(t1 - c1s)", 1)))
            gain = f"({l0} * ({l0}) + {l1} * ({l1})) / ({l0} + {l1}) + ({r0} * ({r0}) + {r1} * ({r1})) / ({r0} + {r1})"
            ctes.append(f"""{n}_h{i} AS (SELECT grp, seed, tree, node, f, bin, CAST(sum(c0) AS BIGINT) AS c0, CAST(sum(c1) AS BIGINT) AS c1
              FROM (SELECT grp, seed, tree, node, c0, c1, unnest({list(range(d))}) AS f, unnest([{bs}]) AS bin FROM {level}) GROUP BY ALL)""")
            ctes.append(f"""{n}_g{i} AS (SELECT *, {gain} AS gain FROM (
              SELECT grp, seed, tree, node, f, bin, CAST(sum(c0) OVER ({of} ORDER BY bin) AS BIGINT) AS c0s,
                     CAST(sum(c1) OVER ({of} ORDER BY bin) AS BIGINT) AS c1s FROM {n}_h{i})
              JOIN {n}_t{i} USING (grp, tree, node) JOIN {n}_w USING (grp)
              WHERE t0 > 0 AND t1 > 0 AND c0s + c1s > 0 AND t0 + t1 - c0s - c1s > 0)""")
            ctes.append(f"""{split} AS MATERIALIZED (SELECT grp, tree, node, f, bin FROM (
              SELECT *, row_number() OVER (PARTITION BY grp, tree, node ORDER BY {_draw('seed', 'tree', 'node * 64 + f')}, f) AS turn
              FROM (SELECT * FROM {n}_g{i} QUALIFY row_number() OVER ({of} ORDER BY gain DESC, bin) = 1))
              WHERE turn <= {FO._picks(d)} QUALIFY row_number() OVER (PARTITION BY grp, tree, node ORDER BY gain DESC, f) = 1)""")
            of_f = "CASE f " + " ".join(f"WHEN {j} THEN b{j}" for j in range(d)) + " END"
            ctes.append(f"""{n}_l{i + 1} AS MATERIALIZED (SELECT grp, seed, tree, 2 * node + CAST({of_f} > bin AS BIGINT) AS node, {bs}, c0, c1, asked
              FROM {level} JOIN {split} USING (grp, tree, node))""")
            rest = f"ANTI JOIN {split} USING (grp, tree, node)"
        ends.append(f"SELECT grp, {bs}, t0, t1 FROM (SELECT * FROM {level} {rest}) JOIN {n}_t{i} USING (grp, tree, node) WHERE asked = 1")
    share = f"coalesce(CAST(floor(t1 * w1 / nullif(t0 * w0 + t1 * w1, 0) * {FO.UNIT} + 0.5) AS BIGINT), 0)"
    ctes.append(f"{n} AS (SELECT grp, {bs}, sum({share}) AS votes FROM ({' UNION ALL '.join(ends)}) JOIN {n}_w USING (grp) GROUP BY ALL)")
    return ",\n".join(ctes)


def rf_utility(trees: int, settings: Sequence[str]) -> str:
    cols = ", ".join(DOC_FEATS)
    both = f"CROSS JOIN (VALUES {', '.join(repr((s,)).replace(',)', ')') for s in settings)}) v(setting)"
    grp = "concat_ws(':', CAST(seed AS VARCHAR), setting) AS grp"
    return f"""{_documents(SEEDS)},
ftr AS (SELECT {grp}, seed, {trees} AS trees, doc_id AS key, target AS y, {cols} FROM tr {both}),
fte AS (SELECT {grp}, seed, setting, {trees} AS trees, target, {cols} FROM split {both} WHERE is_test),
{_forest('rf', 'ftr', 'fte', DOC_FEATS, f"grp LIKE '%{settings[1]}'")},
preds AS (SELECT seed, 'Random Forest' AS model, setting, target AS actual, CAST(2 * votes >= {trees * FO.UNIT} AS INTEGER) AS predicted
          FROM (SELECT *, {_binned(DOC_FEATS, FO.BINS)} FROM fte) JOIN rf USING (grp, {_bs(DOC_FEATS)})),
{_METRICS}"""


def k_utility(feats: Sequence[str], qis: Sequence[str], trees: int) -> str:
    grid = [1, *K_VALUES]
    cols = ", ".join(feats)
    x = [*feats, "one"]

    def scaled(c):
        return f"coalesce(({c} - mn_{c}) / nullif(mx_{c} - mn_{c}, 0), 0.0) AS {c}"

    extra = "o_orderpriority; CAST(year(o_orderdate) AS INTEGER) AS o_year; CAST(month(o_orderdate) AS INTEGER) AS o_month"
    stats = sweep_sql("SELECT seed, count(*) AS n, false AS unclassed, count(CASE WHEN target = 1 THEN 1 END) AS n_pos FROM tr "
                      f"GROUP BY seed, {', '.join(qis)}", by="seed", ks=grid, with_pos=True)
    fits = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in feats)
    head, tail = _METRICS.split("SELECT seed, model, setting,\n   coalesce", 1)
    head = head.replace("SELECT seed, model, setting,", "SELECT seed, k, family,")
    return f"""{_orders(feats, extra)},
stats AS MATERIALIZED (SELECT *, CASE WHEN train_rows_used = 0 THEN '{K.NO_ROWS}'
    WHEN pos_kept = 0 OR pos_kept = train_rows_used THEN '{K.ONE_CLASS}' ELSE '' END AS skipped_reason FROM ({stats})),
k0 AS (SELECT t.*, stats.k AS kk FROM (SELECT *, count(*) OVER (PARTITION BY seed, {', '.join(qis)}) AS cs FROM tr) t
       JOIN stats ON stats.seed = t.seed WHERE cs >= stats.k AND skipped_reason = ''),
mm AS MATERIALIZED (SELECT seed, kk AS k, {fits} FROM k0 GROUP BY seed, kk),
kept AS MATERIALIZED (SELECT printf('%d:%d', k0.seed, k) AS grp, k0.seed, k, o_orderkey, target, {', '.join(scaled(c) for c in feats)}
       FROM k0 JOIN mm ON mm.seed = k0.seed AND mm.k = kk),
tests AS MATERIALIZED (SELECT printf('%d:%d', te.seed, k) AS grp, te.seed, k, target, {', '.join(scaled(c) for c in feats)} FROM te JOIN mm USING (seed)),
{_weights('kept', 'kw', 'grp')},
fx AS MATERIALIZED (SELECT grp, {cols}, w, CAST(1 AS DOUBLE) AS one, CAST(target AS DOUBLE) AS y FROM kw),
{_newton('fit', 'fx', 'grp', x, ['1.0'] * len(feats) + ['0.0'])},
ftr AS (SELECT grp, seed, {trees} AS trees, o_orderkey AS key, target AS y, {cols} FROM kept),
fte AS (SELECT grp, seed, {trees} AS trees, {cols} FROM tests),
{_forest('rf', 'ftr', 'fte', feats, 'true')},
preds AS (SELECT seed, k, 'Logistic Regression' AS family, target AS actual, CAST(1.0 / (1.0 + exp(-({_score(x)}))) >= 0.5 AS INTEGER) AS predicted
          FROM (SELECT *, CAST(1 AS DOUBLE) AS one FROM tests) JOIN fit USING (grp)
          UNION ALL SELECT seed, k, 'Random Forest', target, CAST(2 * votes >= {trees * FO.UNIT} AS INTEGER)
          FROM (SELECT *, {_binned(feats, FO.BINS)} FROM tests) JOIN rf USING (grp, {_bs(feats)})),
{head}, runs AS (SELECT seed, k, family,
   coalesce{tail})
SELECT seed, CASE WHEN k = 1 THEN family ELSE 'K-anonymised ' || family END AS model,
       CASE WHEN k = 1 THEN 'Baseline (No Privacy)' ELSE 'K-anonymity k=' || CAST(k AS VARCHAR) END AS setting,
       train_rows_used, rows_suppressed, suppression_rate, classes_before, classes_after, min_class_size, skipped_reason,
       accuracy, f1, precision, recall
FROM stats CROSS JOIN (VALUES ('Logistic Regression'), ('Random Forest')) v(family) LEFT JOIN runs USING (seed, k, family)"""


DOC_FEATS = ["len_s", "upper_s", "digit_s", "lang_s"]


def _documents(seeds) -> str:
    """CTEs up to ``tr``: scaled documents with their label, per seed."""
    n = "CAST(greatest(length(text), 1) AS DOUBLE)"
    return f"""WITH RECURSIVE
raw AS (SELECT doc_id, CAST(toxic AS INTEGER) AS target, ln(1.0 + CAST(n_chars AS DOUBLE)) AS len_s,
               length(regexp_replace(text, '[^A-Z]', '', 'g')) / {n} AS upper_s,
               length(regexp_replace(text, '[^0-9]', '', 'g')) / {n} AS digit_s,
               CASE WHEN lang IS NOT NULL
                    THEN CAST(dense_rank() OVER (ORDER BY lang NULLS LAST) - 1 AS DOUBLE) END AS lang_s
        FROM documents JOIN labels USING (doc_id)),
lab AS (SELECT doc_id, target, {', '.join(_scaled(c, 'raw') for c in DOC_FEATS)} FROM raw),
{split_ctes('lab', 'doc_id', 'target', seeds=seeds)},
tr AS MATERIALIZED (SELECT * FROM split WHERE NOT is_test)"""


def lr_utility() -> str:
    x = [*DOC_FEATS, "one"]
    return f"""{_documents([42])},
{_weights('tr', 'tw', 'seed')},
fx AS MATERIALIZED (SELECT setting, {', '.join(DOC_FEATS)}, CAST(1 AS DOUBLE) AS one,
         CAST(target AS DOUBLE) AS y, CASE WHEN setting = 'Baseline (balanced)' THEN w ELSE 1.0 END AS w
       FROM tw CROSS JOIN (VALUES ('Baseline (No Privacy)'), ('Baseline (balanced)')) v(setting)),
{_newton('fit', 'fx', 'setting', x, ['1.0'] * len(DOC_FEATS) + ['0.0'])},
preds AS (SELECT seed, 'Logistic Regression' AS model, setting, target AS actual,
                 CAST(1.0 / (1.0 + exp(-({_score(x)}))) >= 0.5 AS INTEGER) AS predicted
          FROM (SELECT *, CAST(1 AS DOUBLE) AS one FROM split WHERE is_test) CROSS JOIN fit),
{_METRICS}"""


def hidden_utility(tail: str = _METRICS) -> str:
    """Hidden scoring has to give the labels of plain scoring."""
    x = [*DOC_FEATS, "one"]
    return f"""{_documents(SEEDS)},
fx AS MATERIALIZED (SELECT *, CAST(1 AS DOUBLE) AS one, CAST(target AS DOUBLE) AS y,
                           CAST(1 AS DOUBLE) AS w FROM tr),
{_newton('fit', 'fx', 'seed', x, ['1.0'] * len(DOC_FEATS) + ['0.0'])},
preds AS (SELECT seed, model, setting, target AS actual,
                 CAST(1.0 / (1.0 + exp(-({_score(x)}))) >= 0.5 AS INTEGER) AS predicted
          FROM (SELECT *, CAST(1 AS DOUBLE) AS one FROM split WHERE is_test) JOIN fit USING (seed)
          CROSS JOIN (VALUES ('Normal Logistic Regression', 'Baseline'),
                             ('HE Logistic Regression Inference', 'Encrypted Inference')) v(model, setting)),
{tail}"""


def hidden_confusion() -> str:
    cells = _METRICS[:_METRICS.index("SELECT seed, model, setting,\n   coalesce")]
    return hidden_utility(f"""{cells}
SELECT seed, model, setting, 0 AS actual_class, tn AS predicted_0, fp AS predicted_1 FROM cells
UNION ALL SELECT seed, model, setting, 1, fn, tp FROM cells""")
