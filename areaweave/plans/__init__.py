"""Configuration, registries and the planner that turns them into one DataFrame."""
