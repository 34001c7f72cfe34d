"""Fixed values of the data model."""

#: Channel order of intensity vectors, and the alphabet of barcodes.
CHANNELS = ["G", "T", "A", "C"]
READ_SCHEMA = "read_id long, x double, y double, values array<array<double>>, sequence string"
EDGE_SCHEMA = "i long, j long, dist double"
