"""The registered queries on the driver's tables and their SQL counterparts."""
