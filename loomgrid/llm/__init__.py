"""Training-data operators on text; nothing in the rest of the library imports this package."""
