"""Reading findings, audit logs and responses; writing what a run produces."""
