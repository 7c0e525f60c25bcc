"""Training-data operators: packing, language models, quality, media, extraction, sharding, sanitising, joins and tokenizing."""
