"""Forced-flow analytics on Spark: fund holdings, index changes and daily bars.

Everything is a lazy DataFrame plan built from built-in Column expressions; see
README.md for the module map.
"""

__version__ = "0.1.0"
