"""Change-risk analytics on Spark: folds, code text features, models, metrics and tests."""

from riskloom.session import materialise, scratch_dir

__all__ = ["materialise", "scratch_dir"]
