"""Column functions: order-preserving keys, row blobs, digests."""
