"""Operators of a training-data pipeline over corpora; nothing else in the library imports this."""
