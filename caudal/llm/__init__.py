"""Operations of a training-data pipeline: search, filters, duplicates, tokens, packing."""
