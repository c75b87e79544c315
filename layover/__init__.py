"""Airline disruption analytics as Spark DataFrame work.

Operators take DataFrames (plus keyword arguments) and return DataFrames.  They never collect,
never need a Python UDF, and take an explicit ``as_of`` wherever a rule depends on the present.
"""

__version__ = "0.1.0"
