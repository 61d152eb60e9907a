"""Registered queries."""

from lociflow.plans import catalogue, extended  # noqa: F401
