"""Composed plans: cleaning the domain sources, the domain panel, model evaluation, test-table queries."""
