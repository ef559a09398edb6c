"""Tables of a world of items, cells and regions: reading, writing, checking."""
