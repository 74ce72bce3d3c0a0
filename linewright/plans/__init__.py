"""Composed jobs, input views and the registered queries."""
