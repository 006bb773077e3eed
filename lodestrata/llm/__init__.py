"""Training-data operators: secrets, chat, near-duplicates, mixing, media, quality, language, packing."""
