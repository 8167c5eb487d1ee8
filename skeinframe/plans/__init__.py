"""Expression trees, datatypes and selectors, resolved to Spark columns at plan time."""
