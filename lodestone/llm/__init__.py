"""Training-data operators: packing, deduplication, tokens, quality, privacy, media, sharding, licences."""
