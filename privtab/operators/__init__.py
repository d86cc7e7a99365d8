"""DataFrame operators.  Each takes and returns DataFrames (plans stay lazy)."""
