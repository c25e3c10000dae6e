"""Training-data operators: filtering, deduplication, mixing, media and token columns."""
