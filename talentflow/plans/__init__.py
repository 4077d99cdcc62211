"""talentflow.plans."""
