"""JSON of any shape into tables: raw records, inferred rules, typed rows, and what was refused and why."""
