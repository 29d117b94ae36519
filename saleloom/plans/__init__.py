"""Model training, scoring and forecasting jobs."""
