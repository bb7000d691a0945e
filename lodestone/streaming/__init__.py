"""Nothing streams here: repeated runs skip what earlier ones have fetched (see operators.outcomes)."""
