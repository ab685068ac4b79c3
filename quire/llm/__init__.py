"""Training-data operators: decontamination, deduplication, packing, labelling, mixing, search."""
