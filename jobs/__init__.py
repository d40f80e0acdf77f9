"""Runnable jobs over folders of tables; each has a function that takes a session, and a command line."""
