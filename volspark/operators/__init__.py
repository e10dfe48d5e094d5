"""Operators over volumes, label maps, tiles and runs: DataFrames in, DataFrames out."""
