"""Training-data operators: text filters, de-duplication, mixing, token files."""
