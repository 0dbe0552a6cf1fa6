"""DataFrame -> DataFrame operators: contract parsing, factor lookups, schedules,
state rolling and nesting."""
