"""Model preparation, training, scoring and explanation on Spark ML."""
