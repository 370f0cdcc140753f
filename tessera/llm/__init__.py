"""Operators for preparing training corpora: packing, media columns, de-duplication, filtering, mixing."""
