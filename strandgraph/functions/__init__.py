"""Integer codes as Column expressions, and their sequential decoders."""
