"""How jobs run: shared storage, sessions and timing."""
