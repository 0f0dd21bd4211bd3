"""Training-data operators: sharding, filters, decontamination, dedup, packing."""
