"""Table operators: DataFrames in, DataFrames out, no clock and no collect."""
