"""Streams of files: an extra beside the batch engine, with the same operators."""
