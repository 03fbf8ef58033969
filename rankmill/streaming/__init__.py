"""The same scores over streams."""
