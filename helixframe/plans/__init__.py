"""Registered queries of the engine."""
