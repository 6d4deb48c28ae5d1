"""Bayesian structural time series on Spark: filtering, sampling, forecasting, impact and attribution over DataFrames."""
