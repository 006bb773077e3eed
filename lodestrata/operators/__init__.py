"""DataFrame operators: trajectories, ranking, summaries, datasets, intents, curricula, registries."""
