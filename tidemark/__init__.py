"""Point-in-time analytics over revised time series, on Spark."""
