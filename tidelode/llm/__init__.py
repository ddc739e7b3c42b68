"""Operators that turn a raw document corpus into training data, one module an operator."""
