"""No streaming operators: every source is a one-shot batch read."""
