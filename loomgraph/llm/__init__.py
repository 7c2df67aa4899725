"""Training-data operators: tokens, quality, near-duplicates, personal data, mixing, licences."""
