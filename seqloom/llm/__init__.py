"""Operators for training data: top rows per group, shared spans, packing, mixing and splitting of texts."""
