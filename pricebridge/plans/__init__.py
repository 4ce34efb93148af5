"""Whole plans: the build, the serving queries, the driver's queries."""
