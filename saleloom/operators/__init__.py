"""DataFrame -> DataFrame operators on the sales panel."""
