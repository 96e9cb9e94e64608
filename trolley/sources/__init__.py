"""Logical tables, text codecs, partitioned tables, shards."""
