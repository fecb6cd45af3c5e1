"""DataFrame operators of the diagnosis chain."""
