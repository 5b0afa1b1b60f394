"""Causal expressions over ordered series."""
