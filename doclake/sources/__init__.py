"""Typed readers and the bindings of star-schema tables to the block model."""
