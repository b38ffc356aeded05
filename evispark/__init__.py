"""evispark: evidence-to-test-plan analytics on Spark."""

__version__ = "0.1.0"
