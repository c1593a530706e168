"""Observational-cohort analytics on Spark DataFrames.

Layers:

* ``sources``   readers and writers for the linked study tables
* ``functions`` column helpers, fixed study values, small numeric helpers
* ``operators`` DataFrame -> DataFrame building blocks and model fits
* ``plans``     the two study pipelines and the registered queries
"""
