"""Part of the read-analytics engine; see README.md."""
