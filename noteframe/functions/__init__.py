"""Column-level helpers: domain constants, md5 hashing, text expressions."""
