"""Table operators: joins, intervals, reshaping, sampling, splits, categories, metrics, comparison, scoring, fitting."""
