"""talentflow.sources."""
