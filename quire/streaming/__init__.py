"""Structured Streaming jobs: resumable corpus load and request streams."""
