"""DataFrame operators: point-in-time join, features, contracts, outcomes,
percentiles, metrics windows, lineage, validation and scoring."""
