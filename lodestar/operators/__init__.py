"""Operators on DataFrames: spatial, network, raster, relational, ranking, calibration, sampling, learning, decision."""
