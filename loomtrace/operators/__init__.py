"""DataFrame operators: grounding, rewards, preference pairs, statistics."""
