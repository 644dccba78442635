"""Relational building blocks: numbering and paging, list reports, keyed changes, ordered conflicts."""
