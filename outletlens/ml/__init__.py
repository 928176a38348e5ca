"""Distributed model preparation, training, evaluation and persistence."""
