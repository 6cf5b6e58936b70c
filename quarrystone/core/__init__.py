"""core of the engine."""
