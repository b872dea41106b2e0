"""Plans assembled from the operators: queries over tables, and the variant pipelines."""
