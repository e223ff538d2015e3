"""Incremental views over keyed tables, workers, schedules, and their Structured Streaming drivers."""
