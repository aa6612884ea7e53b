"""estima: tabular price modelling on Spark DataFrames.

Subpackages: ``sources`` (tables, CSV, inline requests, model registry),
``functions`` (column expressions), ``operators`` (DataFrame -> DataFrame
operators), ``plans`` (train / score plans, registered queries), ``streaming``
(scoring a stream).
"""

__version__ = "0.1.0"
