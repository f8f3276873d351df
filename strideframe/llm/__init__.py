"""Training-data operators: quality rules, deduplication, decontamination, PII, tokenization."""
