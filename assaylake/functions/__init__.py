"""Column -> Column library: text, numbers, potency parsers, rules, features."""
