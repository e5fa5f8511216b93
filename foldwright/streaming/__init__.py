"""Batch and micro-batch scoring."""
