"""talentflow.operators."""
