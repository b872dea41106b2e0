"""Structured-streaming forms of the window, session and pairing kernels."""
