"""Spark jobs for collections of record tables that share one entity key."""
