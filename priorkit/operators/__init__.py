"""DataFrame operators: states, effects, profiles, sequences, entity resolution, metrics."""
