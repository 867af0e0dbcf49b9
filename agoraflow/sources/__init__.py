"""Tables from files and databases, catalogs, configuration, mail and uploads."""
