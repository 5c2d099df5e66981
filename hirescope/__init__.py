"""Posting analytics on Spark: DataFrame operators for job-posting data."""

from hirescope.config import Config, Profile
from hirescope.session import build_session

__all__ = ["Config", "Profile", "build_session"]
