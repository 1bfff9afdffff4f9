"""Streams of new submissions."""
