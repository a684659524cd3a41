"""Incremental maintenance: refresh decisions and streaming state."""
