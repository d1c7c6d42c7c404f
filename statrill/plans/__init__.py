"""Charts: the operators put together, validation and explanations."""
