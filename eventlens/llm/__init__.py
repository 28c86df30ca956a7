"""Operators of a training-data pipeline: filters, sharding, token files,
mixing, packing, chat rendering, quality rules, near-duplicates and
pseudonyms. Nothing else in the library imports this subpackage.
``queries`` registers one query per operator."""
