"""Column expressions: hashing, bit ranks, sizing rules, small scalars."""
