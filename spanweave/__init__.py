"""spanweave: build, validate and score extractive question-answering datasets on Spark."""

__version__ = "0.1.0"
