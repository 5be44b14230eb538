"""Fixed row layouts shared by the operators."""

from __future__ import annotations

CHUNK_COLUMNS = ("source_id", "source_ord", "chunk_ord", "text", "n_chars")
HITS = "query_id bigint, chunk_id bigint, distance double"

# Element categories.
TITLE = "Title"
LIST_ITEM = "ListItem"
NARRATIVE = "NarrativeText"
