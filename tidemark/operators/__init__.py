"""Operators over keyed, ordered series."""
