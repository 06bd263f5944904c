"""DataFrame-to-DataFrame analytics and table mutations."""
