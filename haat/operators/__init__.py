"""Retail operators: each is ``DataFrame -> DataFrame`` over the adapter's
``transactions`` (or another logical table).  No operator collects rows."""
