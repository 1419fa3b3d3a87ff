"""DataFrame operators: labels, dataset assembly, ranking, metrics, scores, term weights, models."""
