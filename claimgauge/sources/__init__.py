"""Reading claims and registries, staging intermediate tables, writing results."""
