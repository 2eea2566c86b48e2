"""Where findings go: baselines, reports."""
