"""Training-corpus operators: cleaning, scoring, deduplication, encoding and packing of documents."""
