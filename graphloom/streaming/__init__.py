"""Continuous replay of the mutation log."""
