"""Training-data operators: text quality, licences, tokens, duplicates, personal data, media, pages, packing, links."""
