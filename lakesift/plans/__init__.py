"""Named query plans over the analytic tables."""
