"""Operators for preparing language-model training data at scale.

Nothing outside this package imports it; ``queries`` holds what the entry
module registers.
"""
