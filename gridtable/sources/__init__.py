"""Files, the commit log, reading and writing."""
