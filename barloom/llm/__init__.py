"""Training-data operators: deduplication, mixing, filters, classifiers, search."""
