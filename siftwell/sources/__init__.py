"""Readers that turn files, tables and settings into DataFrames."""
