"""Table jobs: each takes DataFrames and returns DataFrames, and runs nothing on its own."""
