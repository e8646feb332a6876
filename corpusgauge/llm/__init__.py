"""Operations of a training-data pipeline: tokens, packing, quality, toxicity, duplicates, embeddings and archives."""
