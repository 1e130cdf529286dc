"""Training-data operators: near-duplicates, language, toxicity, quality, counts, fingerprints, rules, mixing, packing."""
