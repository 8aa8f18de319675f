"""DataFrame operators: cleaning, history, statistics, encoding, splits, models."""
