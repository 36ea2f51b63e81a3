"""Training-data operators: filtering, deduplication, scanning, extraction and packing of text corpora."""
