"""Relational and grouped operators: meshes, neighbours, fields, predictions, kernels, partitions, blocks."""
