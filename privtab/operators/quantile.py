"""Exact medians without gathering a column into one task.

Spark's exact ``percentile``/``median`` merges every distinct value of the
column into one aggregation buffer; on a continuous column of billions of
rows that buffer is the whole column.  Here a mergeable sketch of bounded size
gives two edges closely around the middle rank (they are values of the column,
so infinities and any spread of magnitudes are fine), exact counts at the edges
say which open interval holds the rank, and an interval of at most FEW rows is
fetched as distinct values with counts.  All columns share the three jobs; an
interval of more rows is sketched and counted again (a pass leaves about
5 / SKETCH of the rows).  An edge that is the value itself ends the search, so
a value shared by many rows is never fetched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: a rank is met within 1 / SKETCH of the rows.
SKETCH = 5000
#: Most rows of a column whose values are fetched.
FEW = 8192


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Median of each column, interpolating between the two middle values
    for an even count (NULL and NaN ignored); None for an empty column."""
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}
    value = {}
    for c in cols:
        x = F.col(c).cast("double")
        value[c] = F.when(~F.isnan(x), x)
    low: dict[str, float] = {}   # the answer is above
    high: dict[str, float] = {}  # and below
    middle: dict[str, tuple[float, float | None]] = {}  # the values of the middle rank and the next

    def inside(c):
        cond = value[c].isNotNull()
        if c in low:
            cond = cond & (value[c] > F.lit(low[c]))
        if c in high:
            cond = cond & (value[c] < F.lit(high[c]))
        return F.when(cond, value[c])

    def sketch(names, share):
        """Two values around each share of the rows inside, and how many rows."""
        near = 2 / SKETCH
        row = df.agg(*[f.alias(f"{name}{i}") for i, c in enumerate(names) for name, f in (
            ("n", F.count(inside(c))),
            ("q", F.percentile_approx(inside(c), [max(0.0, share[c] - near), min(1.0, share[c] + near)], SKETCH)))]).first()
        return {c: row[f"n{i}"] for i, c in enumerate(names)}, {c: row[f"q{i}"] for i, c in enumerate(names)}

    size, edges = sketch(cols, dict.fromkeys(cols, 0.5))
    rank = {c: (size[c] - 1) // 2 for c in cols}
    since, until = dict.fromkeys(cols, 0), dict(size)  # ranks of the rows inside
    while wide := [c for c in cols if c not in middle and until[c] - since[c] > FEW]:
        if not edges:
            _, edges = sketch(wide, {c: (rank[c] - since[c] + 0.5) / (until[c] - since[c]) for c in wide})
        asked = [(c, e) for c in wide for e in sorted(set(edges[c]))]
        row = df.agg(*[f.alias(f"{name}{i}") for i, (c, e) in enumerate(asked) for name, f in (
            ("b", F.count_if(value[c] < F.lit(e))), ("u", F.count_if(value[c] <= F.lit(e))),
            ("m", F.min(F.when(value[c] > F.lit(e), value[c]))))]).first()
        for i, (c, e) in enumerate(asked):
            below, upto = row[f"b{i}"], row[f"u{i}"]
            if rank[c] < below:
                if below < until[c]:
                    high[c], until[c] = e, below
            elif rank[c] < upto:
                middle[c] = e, e if rank[c] + 1 < upto else row[f"m{i}"]
            elif upto > since[c]:
                low[c], since[c] = e, upto
        edges = {}
    rest = [c for c in cols if size[c] and c not in middle]
    if rest:
        pairs = [F.when(inside(c).isNotNull(), F.struct(F.lit(i).alias("i"), inside(c).alias("v")))
                 for i, c in enumerate(rest)]
        rows = (df.select(F.explode(F.array_compact(F.array(*pairs))).alias("p")).groupBy("p.i", "p.v")
                .agg(F.count("*").alias("n")).collect())
        values: list[list[tuple[float, int]]] = [[] for _ in rest]
        for r in rows:
            values[r["i"]].append((r["v"], r["n"]))
        for c, mine in zip(rest, values):
            mine.sort()
            at = since[c]
            for k, (v, n) in enumerate(mine):
                at += n
                if rank[c] < at:
                    after = mine[k + 1][0] if k + 1 < len(mine) else high.get(c)
                    middle[c] = v, v if rank[c] + 1 < at else after
                    break
    out: dict[str, float | None] = {}
    for c in cols:
        first, second = middle.get(c, (None, None))
        out[c] = first if size[c] % 2 or first == second else first + (second - first) * 0.5
    return out
