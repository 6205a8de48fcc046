"""Event-time versions of windowed operators."""
