"""Where fields come from: the star-schema tables and a test kernel."""
