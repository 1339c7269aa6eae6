"""Operators of a training-data pipeline: near copies, counts, mixing, sharding, encoding, language, licences."""
