"""The jobs that work row by row, over files as they arrive."""
