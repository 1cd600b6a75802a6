"""Training-data operators: quality, mixing, counting, sharding, secrets, dedup, BPE, HTML and repeated spans."""
