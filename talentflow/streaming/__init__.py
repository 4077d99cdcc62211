"""talentflow.streaming."""
