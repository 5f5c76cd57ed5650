"""Spark jobs that audit collections of versioned prompts, rules and test results."""

__version__ = "0.1.0"
