"""Whole plans: the snapshot store, incremental updates, builds, mounts, and the driver's queries."""
