"""mailtriage: bulk triage of forwarded suspicious mail, as Spark DataFrame jobs."""

from mailtriage.config import TriageConfig

__all__ = ["TriageConfig"]
