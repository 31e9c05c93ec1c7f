"""Names that an operator may use for its own columns."""

CLASH = ("row", "doc", "key", "word", "other0", "null", "n", "text_hash")
