"""Training-data operators: cleaning, de-duplication, tokenising and sharding of text at corpus scale.

Nothing outside this subpackage imports it.
"""
