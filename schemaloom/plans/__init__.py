"""Part of schemaloom."""
