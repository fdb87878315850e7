"""DataFrame operators: extraction, retrieval, evaluation, index upkeep."""
