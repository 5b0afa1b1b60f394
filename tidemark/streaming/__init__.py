"""Replay of series as streams."""
