"""Composed plans: panel, evaluation, gate, manifest."""
