"""Training-data operators: sharding, near-dedup, quality, chat, mixing, secrets, token counts, decontamination, toxicity, language."""
