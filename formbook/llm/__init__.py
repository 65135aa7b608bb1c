"""Operators for large training-data pipelines: tokens, packing, language, quality, licences, media, toxicity, near copies, chat."""
