"""Access-accountability and audit-evidence jobs as PySpark DataFrame transformations."""
