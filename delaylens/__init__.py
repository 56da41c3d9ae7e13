"""delaylens: transit-delay analytics as Spark DataFrame operators.

Every public function takes DataFrames (and plain Python parameters) and
returns a lazily planned DataFrame; nothing is collected to the driver.
"""

from delaylens.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
