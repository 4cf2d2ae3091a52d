"""Plans: staging / intermediate / mart models, parameterised queries,
derived analytics, features and models — all DataFrame functions."""
