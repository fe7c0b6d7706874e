"""stridelake: a PySpark-native analytics engine for episodic trajectory data."""

from stridelake.session import build_session

__all__ = ["build_session"]
