"""Standing queries over streams of quads or rows."""
