"""Training tables, models, metrics and inference."""
