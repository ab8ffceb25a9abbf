"""Grid-job and network-health analytics on Spark DataFrames."""

from gridlens.session import shared_dir, tune

__all__ = ["shared_dir", "tune"]
