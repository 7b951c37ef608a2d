"""Training-data operators: formatting, deduplication, extraction, filtering, scoring, mixing."""
