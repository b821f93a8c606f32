"""Claim-graph analytics on Spark: DataFrame in, DataFrame out."""
