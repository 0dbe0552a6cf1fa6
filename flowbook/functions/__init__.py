"""Column expressions: text parsing, cycles and periods, date shifts, day counts."""
