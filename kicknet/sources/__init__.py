"""Reading observations and taxa, writing scores."""
