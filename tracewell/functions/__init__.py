"""Column functions: predicates with two-valued logic, text and number forms, addresses, packet fields."""
