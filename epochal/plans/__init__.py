"""Statement language, catalog and driver-contract queries."""
