"""Jobs over DataFrames: retrieval, statistics, sampling, features, models, metrics."""
