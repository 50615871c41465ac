"""Training-data operators: secret scan, line and near-duplicate removal,
language identification, exact dedup, tokenisation, sharding, embedding
near-dedup, URL rules and source mixing.

Nothing outside this subpackage imports it.
"""
