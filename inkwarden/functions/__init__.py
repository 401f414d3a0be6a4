"""Column functions: masking, digests, checksums, text offsets."""
