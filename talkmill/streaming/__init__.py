"""Structured streams of turns, histories and signals."""
