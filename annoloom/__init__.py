"""annoloom: entity linking and annotation analytics as Spark plans."""
