"""Column arithmetic and numpy cores that run inside a task."""
