"""Training-data operators: extraction, deduplication, decontamination, quality, language model, packing and token counts."""
