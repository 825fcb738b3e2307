"""The same flows on arriving files."""
