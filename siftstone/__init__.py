"""Code and document retrieval as Spark jobs: index, search and evaluate."""
