"""DataFrame operators over the disruption tables."""
