"""tripline: travel timelines from photo exports, as PySpark DataFrame jobs."""

from tripline.session import tune

__all__ = ["tune"]
