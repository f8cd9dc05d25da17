"""DataFrame -> DataFrame building blocks; every result is lazy."""
