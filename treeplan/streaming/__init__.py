"""Plans over arriving snapshots."""
