"""Readers and writers: repository snapshots, diffs, configuration, caches."""
