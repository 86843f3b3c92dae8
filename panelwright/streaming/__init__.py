"""Structured Streaming into panels."""
