"""Training-data operators.

Nothing outside this subpackage imports it.  ``registry`` holds the thin contract
queries and their SQL; every other module is an operator with its own interface.
"""
