"""Feature programs: schema, language, window notation, planner and SQL text."""
