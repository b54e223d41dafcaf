"""Operators for preparing training data: mixing, scans, filters, packing, token counts, ranking, search and near-duplicates."""
