"""Operators for large text corpora: packing, sharding, filters, dedup, fingerprints, formatting.

`QUERIES` and `ORACLES` hold the registered queries of this subpackage; nothing else in the library imports it.
"""
