"""Pipeline composition, the registered query catalog and its SQL oracle."""
