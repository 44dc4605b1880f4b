"""DataFrame operators: cleaning, validation, merging, scoring, metrics."""
