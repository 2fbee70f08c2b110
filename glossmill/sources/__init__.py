"""Where files come from and where they go."""
