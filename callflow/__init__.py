"""callflow: conversation analytics over whole corpora of calls, on Spark."""

__version__ = "0.1.0"
