"""Model fitting and evaluation on Spark ML."""
