"""Reading, writing, binding and generating the five tables."""
