"""fathomline: a PySpark engine for ordered survey observations."""
