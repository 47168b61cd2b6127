"""Readers, incremental merges and partitioned stores."""
