"""Operators for building training corpora; see each module for its contract."""
