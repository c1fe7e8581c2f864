"""Operators for preparing training text: mixing, packing, search, quality, language model, pieces, near copies,
shard placement, token counts and license scans. Nothing outside this subpackage imports it."""
