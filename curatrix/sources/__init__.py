"""Corpora, caches, result files, injected generators and encoders."""
