"""Queries as declarative plans; ``queries`` and ``oracles`` pair each with its SQL."""
