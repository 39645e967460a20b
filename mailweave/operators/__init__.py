"""DataFrame -> DataFrame operators of the core library."""
