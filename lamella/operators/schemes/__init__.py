"""Encoding schemes. Each module has encode functions that give an EncodedColumn, and decode(column, lo, hi), which
gives (pos, value) for positions lo <= pos < hi (all by default) and reads only the segments that hold them."""
