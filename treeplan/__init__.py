"""Tree synchronisation and deduplication as DataFrame plans."""
