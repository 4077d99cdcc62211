"""talentflow.functions."""
