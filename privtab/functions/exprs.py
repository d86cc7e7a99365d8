"""Column expressions shared by the operators (all JVM-side, no UDF)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def recode(col, mapping: Mapping) -> Column:
    """P5: map values through ``mapping``; unmapped values become NULL."""
    c = _c(col)
    out = None
    for src, dst in mapping.items():
        out = (F.when(c == F.lit(src), F.lit(dst)) if out is None
               else out.when(c == F.lit(src), F.lit(dst)))
    return out


def band(col, edges: Sequence[float]) -> Column:
    """K5/K6: right-closed bands ``(e_i, e_{i+1}]`` coded 0..n-1.

    The first band also holds its lower edge; values outside every band and
    NULL give NULL.  (A left-closed bucketizer would put an edge value in the
    next band.)
    """
    c = _c(col)
    e = [float(x) for x in edges]
    out = F.when((c >= F.lit(e[0])) & (c <= F.lit(e[1])), F.lit(0))
    for i in range(1, len(e) - 1):
        out = out.when((c > F.lit(e[i])) & (c <= F.lit(e[i + 1])), F.lit(i))
    return out.cast("int")


def finite_or(col, value: float = 0.0) -> Column:
    """NULL, NaN and +/-inf become ``value``."""
    c = _c(col).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(value))).otherwise(c)


def ratio(num, den) -> Column:
    """Integer ratio as double, 0.0 when undefined (zero denominator)."""
    n, d = _c(num), _c(den)
    return F.coalesce(F.try_divide(n.cast("double"), F.nullif(d, F.lit(0)).cast("double")),
                      F.lit(0.0))


def round_half_up_ratio(num, den, places: int, scale: int = 1) -> Column:
    """round(scale * num / den, places) half-up, computed exactly on integers.

    Equals decimal rounding of the exact quotient (no binary-float ties);
    0.0 when ``den`` is 0.  SQL twin: ``CAST((2*scale*10^p*num + den) //
    (2*den) AS DOUBLE) / 10^p``.
    """
    n = _c(num).cast("decimal(38,0)")
    d = _c(den).cast("decimal(38,0)")
    p = 10 ** places
    q = F.floor((n * F.lit(2 * scale * p) + d) / (d * F.lit(2)))
    return F.when(_c(den) == 0, F.lit(0.0)).otherwise(q.cast("double") / F.lit(float(p)))


def round_fixed(col, places: int) -> Column:
    """Round half-up to ``places`` decimals as ``floor(x * 10^p + 0.5) / 10^p``.

    Built only from IEEE operations, so any engine computing the same
    double gets the same rounded double (decimal-text rounding and
    binary-value rounding disagree on values whose shortest text ends in 5).
    """
    p = float(10 ** places)
    x = _c(col).cast("double")
    return F.floor(x * F.lit(p) + F.lit(0.5)).cast("double") / F.lit(p)


def sigmoid(score) -> Column:
    """logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(score)))


def threshold(prob, cut: float = 0.5) -> Column:
    """Label 1 when probability >= cut; NULL stays NULL."""
    return (_c(prob) >= F.lit(cut)).cast("int")


def mean_std_text(mean, std, na_text: str | None = "NA") -> Column:
    """``'%.4f ± %.4f'``; std NULL prints 0; mean NULL prints ``na_text``."""
    m, s = _c(mean), _c(std)
    text = F.format_string("%.4f ± %.4f", m, F.coalesce(s, F.lit(0.0)))
    if na_text is None:
        return text
    return F.when(m.isNull(), F.lit(na_text)).otherwise(text)
