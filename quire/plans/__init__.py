"""Whole jobs: the incremental corpus load, the derived fixture views and
the registry of named queries used by the driver and bench."""
