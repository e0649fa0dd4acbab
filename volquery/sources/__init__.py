"""Where volumes, lookups and telemetry come from and go to."""
