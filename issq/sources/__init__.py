"""Table layouts, image files and relations derived from the driver tables."""
