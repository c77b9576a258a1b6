"""Compositions of operators: cohort bindings, study runs, grid search, risk ensemble."""
