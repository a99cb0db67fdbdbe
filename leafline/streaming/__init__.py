"""Progress of runs as a stream."""
