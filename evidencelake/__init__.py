"""Evidence-first document audit as lazy, deterministic Spark DataFrame plans."""

from evidencelake.session import build_session

__all__ = ["build_session"]
