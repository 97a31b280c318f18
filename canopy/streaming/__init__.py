"""The same counts over streams."""
