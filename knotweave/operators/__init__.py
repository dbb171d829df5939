"""DataFrame operators: chunking, retrieval, indexing, graphs, decisions, merges, metrics."""
