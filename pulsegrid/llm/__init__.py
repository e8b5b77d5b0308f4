"""Training-data operators: quality, fingerprints, tokenisation, deduplication, toxicity and mixing of documents."""
