"""Operators for preparing training data: language, copies, personal data, mixing, packing, archives, search."""
