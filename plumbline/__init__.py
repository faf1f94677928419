"""Automated data profiling on Spark: any table in, typed result tables out."""
