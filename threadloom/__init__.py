"""Conversation analytics on Spark DataFrames.

``sources``    reading, validating and writing the tables
``functions``  column expressions for text, time and ids
``operators``  DataFrame-in / DataFrame-out building blocks
``plans``      the end-to-end jobs made of those operators
``streaming``  the same rules over Structured Streaming sources
"""

__version__ = "0.1.0"
