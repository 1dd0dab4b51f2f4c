"""Training-data operators: WARC, chat formatting, packing, fingerprints, language id, quality, mixing, deduplication."""
