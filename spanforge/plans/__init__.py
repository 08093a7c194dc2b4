"""Named queries over the driver's tables, and SQL for those that SQL can express."""
