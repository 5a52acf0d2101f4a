"""Runnable jobs over the library's operators; each has a command line and a JSON config of its own."""
