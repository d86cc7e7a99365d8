"""Report-label functions (F1-F10) as column expressions.

Every rule is a CASE/regex expression evaluated inside whole-stage codegen;
none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short model names used by the published reports, in the
# order the reports list them (exact, case-sensitive match; others unchanged).
SHORT_MODEL_NAMES = {
    "DP Logistic Regression": "DP LR",
    "DP Random Forest": "DP RF",
    "Federated Logistic Regression": "FL LR",
    "Federated Random Forest": "FL RF",
    "K-anonymised Logistic Regression": "K-Anon LR",
    "K-anonymised Random Forest": "K-Anon RF",
    "HE Logistic Regression Inference": "HE LR",
    "Normal Logistic Regression": "LR",
    "Logistic Regression": "LR",
    "Random Forest": "RF",
}

# Setting patterns, tried in this order (first match wins).
K_PATTERN = r"(?i)k=(\d+)"
EPS_PATTERN = r"e=(\d+\.?\d*)"
FL_PATTERN = r"FL \((\d+) clients, (\d+) rounds\)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def short_model(model) -> Column:
    """short model name by exact lookup; unknown names unchanged."""
    m = _c(model)
    out = None
    for full, short in SHORT_MODEL_NAMES.items():
        out = (F.when(m == F.lit(full), F.lit(short)) if out is None
               else out.when(m == F.lit(full), F.lit(short)))
    return out.otherwise(m)


def short_setting(setting) -> Column:
    """Baseline / k=.. / ε=.. / FL clients+rounds / Encrypted / unchanged."""
    s = _c(setting)
    return (F.when(s.contains("Baseline"), F.lit("Baseline"))
            .when(s.rlike(K_PATTERN),
                  F.concat(F.lit("k="), F.regexp_extract(s, K_PATTERN, 1)))
            .when(s.rlike(EPS_PATTERN),
                  F.concat(F.lit("ε="), F.regexp_extract(s, EPS_PATTERN, 1)))
            .when(s.rlike(FL_PATTERN),
                  F.concat(F.regexp_extract(s, FL_PATTERN, 1), F.lit(" clients\n"),
                           F.regexp_extract(s, FL_PATTERN, 2), F.lit(" rounds")))
            .when(s.contains("Encrypted Inference"), F.lit("Encrypted"))
            .otherwise(s))


def combined_label(model, setting) -> Column:
    """``<short model>\\n(<short setting>)``."""
    return F.concat(short_model(model), F.lit("\n("), short_setting(setting), F.lit(")"))


def mean_of(text) -> Column:
    """the number before ``±`` (or the whole text), NULL if not numeric."""
    return (F.trim(F.split(_c(text), "±").getItem(0))).try_cast("double")


def std_of(text) -> Column:
    """the number after ``±``; 0 when the text has no ``±``."""
    t = _c(text)
    return F.when(t.contains("±"),
                  (F.trim(F.split(t, "±").getItem(1))).try_cast("double")
                  ).otherwise(F.lit(0.0))


def epsilon_of(setting) -> Column:
    """ε parsed from ``e=<number>``; NULL if absent."""
    return (F.regexp_extract(_c(setting), EPS_PATTERN, 1)).try_cast("double")


def k_of(setting) -> Column:
    """k parsed from ``k=<int>``; NULL if absent."""
    return (F.regexp_extract(_c(setting), r"k=(\d+)", 1)).try_cast("int")


def setting_text(kind: str, *params) -> Column:
    """F8: setting text from parameters (columns or literals)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in params]
    formats = {"dp": "DP e=%s", "fl": "FL (%s clients, %s rounds)",
               "kanon": "K-anonymity k=%s"}
    return F.format_string(formats[kind], *[c.cast("string") for c in cols])


def model_from_method(model, method) -> Column:
    """``Model`` falls back to ``Method``."""
    return F.coalesce(_c(model), _c(method))


def setting_from_model(model) -> Column:
    """encrypted-inference rows vs baseline rows, from the model name."""
    return F.when(_c(model).contains("HE"), F.lit("Encrypted Inference")).otherwise(
        F.lit("Baseline"))
