"""posefarm: generate, score, label and rank rigid-body poses with Spark DataFrames."""
