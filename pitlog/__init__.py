"""Point-in-time features, leakage audits and model evaluation on event logs, on Spark."""
