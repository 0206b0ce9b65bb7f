"""Training-data operators: tokens, chat, secrets, mixing, near duplicates, decontamination, search, toxicity, lines, shards."""
