"""Operators for preparing training data; see ``queries`` for the registered ones."""
