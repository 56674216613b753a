"""DataFrame-level operators over the place relation."""
