"""pulsegrid: batch biosignal studies as Spark DataFrame jobs."""

__version__ = "0.1.0"
