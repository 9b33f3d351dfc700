"""Training-data operators: ten corpus-scale components that nothing else in the library imports."""
