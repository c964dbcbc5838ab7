"""cartulary: a PySpark library for geospatial feature layers.

Layers are DataFrames of features; indexes are exploded tables; every query
builds a lazy plan and leaves the physical strategy to Catalyst and AQE.
"""
