"""Training-data operators: ten corpus operations, each usable on its own.

Nothing outside this subpackage imports it.
"""
