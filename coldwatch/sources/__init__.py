"""Where telemetry and alerts come from and go to."""
