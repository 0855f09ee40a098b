"""Rules over streams of facts."""
