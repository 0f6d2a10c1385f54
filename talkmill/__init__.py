"""Dialogue-corpus analytics on Spark."""
