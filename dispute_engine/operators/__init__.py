"""DataFrame -> DataFrame operators of the dispute pipeline."""
