"""Camera-trap analytics on Spark: DataFrame in, DataFrame out."""
