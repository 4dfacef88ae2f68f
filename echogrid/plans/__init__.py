"""Multi-step plans: readiness and jobs, retention, rendering, nowcasts."""
