"""Typed property graphs at scale: build, merge, validate, query and measure them with Spark."""
