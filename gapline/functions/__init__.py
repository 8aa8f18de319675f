"""Column expressions: text repair, time parsing and parts, bins and flags."""
