"""Entity-evidence engine on Spark: registry, awards, changes, pages, claims and audits as DataFrame jobs."""

from .session import build_session, checkpoint, session_checkpoint_dir

__all__ = ["build_session", "checkpoint", "session_checkpoint_dir"]
