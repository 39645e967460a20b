"""Query registry and composed pipelines."""
