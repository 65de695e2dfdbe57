"""Training-data operators: decontamination, near-dedup, language, URLs, fingerprints, shards, toxicity, tokens, packing."""
