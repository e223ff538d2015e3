"""Operators that Spark lacks: search over keyed tables, full text, and schema-inferring ingest."""
