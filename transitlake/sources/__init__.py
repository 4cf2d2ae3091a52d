"""Sources: entity schemas/registry, landed-document readers, driver-table proxy."""
