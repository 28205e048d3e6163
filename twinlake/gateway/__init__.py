"""Read-only access: statements, catalog, rendering, prompt, command line and tool server."""
