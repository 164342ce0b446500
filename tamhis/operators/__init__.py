"""DataFrame operators: quality, spelling, terms, vectors, clusters, metrics."""
