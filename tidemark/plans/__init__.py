"""End-to-end pipelines assembled from the operators."""
