from privtab.functions.hashing import hash_bucket, hash_hex, hash_unit
from privtab.functions.exprs import (
    band,
    finite_or,
    mean_std_text,
    ratio,
    recode,
    round_fixed,
    round_half_up_ratio,
    sigmoid,
    threshold,
)
from privtab.functions.labels import (
    combined_label,
    epsilon_of,
    k_of,
    mean_of,
    model_from_method,
    setting_from_model,
    setting_text,
    short_model,
    short_setting,
    std_of,
)

__all__ = [
    "band", "combined_label", "epsilon_of", "finite_or", "hash_bucket", "hash_hex",
    "hash_unit", "k_of", "mean_of", "mean_std_text", "model_from_method", "ratio",
    "recode", "round_fixed", "round_half_up_ratio", "setting_from_model", "setting_text",
    "short_model", "short_setting", "sigmoid", "std_of", "threshold",
]
