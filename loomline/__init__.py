"""Continuity analytics on Spark: packets, encodings, replay, access and scoring as DataFrame operators."""
