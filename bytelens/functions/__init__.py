"""Column functions: descriptors, flags, text, emulated scalar library."""
