"""Slow-payer classifier on Spark ML: split, features, metrics, training, scoring."""
