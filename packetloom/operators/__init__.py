"""Relational operators over frames, sessions and connection events."""
