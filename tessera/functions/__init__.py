"""Part of the tessera library."""
