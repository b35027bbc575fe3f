"""Table catalogue, readers, conversion job and sinks."""
