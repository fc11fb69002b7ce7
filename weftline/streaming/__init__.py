"""Structured Streaming variants of the time-window operators."""
