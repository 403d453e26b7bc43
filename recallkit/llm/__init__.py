"""Operators for preparing language-model training data.

Every module holds one operator; ``queries`` registers them. Nothing outside this
subpackage imports it.
"""
