"""Training-data operators: formatting, decontamination, deduplication, scoring, extraction."""
