"""Stores of samples and what fills them."""
