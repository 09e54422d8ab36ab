"""Results as streams of rows, and jobs that make them. The language itself has no streaming sources."""
