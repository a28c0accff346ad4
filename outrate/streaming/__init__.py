"""Streams of rows against what a batch has found."""
