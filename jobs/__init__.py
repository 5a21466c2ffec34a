"""Runnable jobs: each is a function of a session, a command line and a configuration file beside it."""
