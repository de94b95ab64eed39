"""Training-data operators: mixing, search, scoring, redaction, encoding, deduplication, licences."""
