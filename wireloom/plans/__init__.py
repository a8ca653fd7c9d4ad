"""Plans: whole documents to feeds and entries, and reports on them."""
