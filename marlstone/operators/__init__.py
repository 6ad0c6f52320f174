"""Relational operators: windows, as-of joins, folds, scoring, portfolio, diagnostics."""
