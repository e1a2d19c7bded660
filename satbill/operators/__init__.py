"""Table jobs: every function takes and returns lazy DataFrames."""
