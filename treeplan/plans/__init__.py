"""The decision ladder and what follows from it."""
