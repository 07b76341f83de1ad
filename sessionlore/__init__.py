"""History-aware feature engineering and model scoring over event logs, on Spark."""
