"""Business diagnostics as Spark jobs: DataFrame in, DataFrame out."""
