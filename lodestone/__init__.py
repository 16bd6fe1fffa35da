"""Lodestone: a PySpark-native evidence and knowledge analytics engine.

Every operator is a function from DataFrames to a DataFrame; nothing is collected to the
driver inside an operator unless its docstring states the bound.
"""

__version__ = "0.1.0"
