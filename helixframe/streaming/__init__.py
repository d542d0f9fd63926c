"""The engine's stateless maps and counters on streams."""
