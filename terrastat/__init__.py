"""Territorial analytics on Spark DataFrames.

functions  column expressions (text, location codes, numbers)
operators  DataFrame -> DataFrame building blocks
sources    readers and the model store
plans      whole reports composed from the operators
"""
